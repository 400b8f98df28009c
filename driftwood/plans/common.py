"""Shared pieces of the registered queries: rounding for the oracle
comparison, the derived views (scored documents, event halves), and their
DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from driftwood.sources.tables import table

PLACES = 6


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Round every floating column (summation order differs between
    engines; 6 places is the comparison precision)."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), places).alias(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


# --- scored documents: labels joined to documents, fixed arithmetic score ---
# score has 1000 distinct values over ~n_chars, so ties are frequent on purpose

def scored_documents(spark: SparkSession, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "n_chars"])
    labels = table(spark, sf_dir, "labels", ["doc_id", "quality"])
    score = (F.pmod(F.col("n_chars") * 37, F.lit(1000)) / 1000.0)
    return (labels.join(docs, "doc_id")
            .select("doc_id", F.col("quality").alias("label"), score.alias("score"))
            .withColumn("prediction", (F.col("score") >= threshold).cast("int")))


SCORED_SQL = """scored AS (
  SELECT l.doc_id, l.quality AS label,
         ((d.n_chars * 37) % 1000) / 1000.0 AS score,
         CAST(((d.n_chars * 37) % 1000) / 1000.0 >= 0.5 AS INTEGER) AS prediction
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


# --- events split in two halves of January 2024 ---
SPLIT_TS = "2024-01-16"


def event_halves(spark: SparkSession, sf_dir: str, shifted: bool = False):
    ev = table(spark, sf_dir, "events", ["ts", "event_type", "value"])
    cut = F.lit(SPLIT_TS).cast("timestamp_ntz")
    ref = ev.where(F.col("ts") < cut).select("event_type", "value")
    cur = ev.where(F.col("ts") >= cut).select("event_type", "value")
    if shifted:
        # positive control: shifted values, one event type missing
        cur = cur.where(F.col("event_type") != "error") \
            .select("event_type", (F.col("value") * 1.2).alias("value"))
    return ref, cur


def event_halves_sql(shifted: bool = False) -> str:
    cur_value = "value * 1.2" if shifted else "value"
    cur_filter = " AND event_type <> 'error'" if shifted else ""
    return f"""ref AS (SELECT event_type, value FROM events WHERE ts < TIMESTAMP '{SPLIT_TS}'),
cur AS (SELECT event_type, {cur_value} AS value FROM events
        WHERE ts >= TIMESTAMP '{SPLIT_TS}'{cur_filter})"""
