"""Streaming forms of the drift check and batch scoring.

* ``drift_monitor``: every micro-batch of incoming rows is tested against a
  reference table, or its stored summary; the table is summarised once when
  the stream starts and not read again.  Reports are written under ``batch_id=<n>`` with dynamic
  partition overwrite, so a replayed batch replaces its own report
  (effectively exactly-once on top of foreachBatch's at-least-once).
* ``scoring_stream``: a fitted pipeline applied to a stream (projection
  only) into a checkpointed file sink (exactly-once).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftwood.operators import summaries
from driftwood.session import cut_lineage


def drift_monitor(reference: DataFrame, stream: DataFrame, numeric: list[str],
                  categorical: list[str], sink_path: str, checkpoint: str,
                  alpha: float = 0.05, available_now: bool = True,
                  processing_time: str | None = None, summarised: bool = False) -> StreamingQuery:
    """``summarised`` says that ``reference`` is a merged summary already
    (see ``summaries.read_summary``)."""
    known = cut_lineage(reference if summarised else summaries.merge(
        summaries.summarise(reference, numeric, categorical)))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        # the report runs several jobs over the batch: read it once
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if batch.isEmpty():
                return
            now = summaries.merge(summaries.summarise(batch, numeric, categorical))
            report = summaries.report(known, now, alpha)
            (report.withColumn("batch_id", F.lit(batch_id))
             .withColumn("checked_at", F.current_timestamp())
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("batch_id").parquet(sink_path))
        finally:
            batch.unpersist()

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


def scoring_stream(model, stream: DataFrame, key: str, sink_path: str, checkpoint: str,
                   available_now: bool = True) -> StreamingQuery:
    from driftwood.operators.models import batch_predict
    scored = batch_predict(model, stream, key)
    w = (scored.writeStream.format("parquet").option("path", sink_path)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
