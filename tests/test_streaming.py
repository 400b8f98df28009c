"""Streaming drift monitor and scoring stream on file sources."""

from pyspark.sql import functions as F

from driftwood.operators import models as L
from driftwood.operators import preprocess as E
from driftwood.sources.tables import table
from driftwood.streaming.monitor import drift_monitor, scoring_stream

from conftest import SF_SMALL


def test_drift_monitor_batches(spark, tmp_path):
    ev = table(spark, SF_SMALL, "events", ["ts", "event_type", "value"])
    ref = ev.where(F.col("ts") < "2024-01-16").drop("ts")
    incoming = str(tmp_path / "incoming")
    cur = ev.where(F.col("ts") >= "2024-01-16").drop("ts")
    cur.repartition(3).write.parquet(incoming)
    src = spark.readStream.schema(cur.schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    q = drift_monitor(ref, src, ["value"], ["event_type"], str(tmp_path / "reports"),
                      str(tmp_path / "ckpt"))
    q.awaitTermination(300)
    rep = spark.read.parquet(str(tmp_path / "reports"))
    assert rep.select("batch_id").distinct().count() == 3
    assert rep.count() == 6
    assert set(rep.columns) >= {"feature", "metric_value", "p_value", "drift_detected"}


def test_scoring_stream(spark, tmp_path):
    rows = [(i, float(i % 13), float(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, label double")
    model = L.build_pipeline(E.Layout(scaled=("a",)), L.classifier("logistic_regression", label="label")).fit(df)
    src_dir = str(tmp_path / "src")
    df.drop("label").write.parquet(src_dir)
    stream = spark.readStream.schema("id long, a double").parquet(src_dir)
    q = scoring_stream(model, stream, "id", str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(300)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 200 and out.columns == ["id", "prediction", "churn_probability"]
