"""File sources and sinks: CSV with an explicit schema, split tables,
the feature registry document, drift-report records.

Rows carry a key everywhere: features and target written as separate
tables can be joined back on it (position is not preserved by Spark).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, LongType, StringType,
                               StructField, StructType)

# The churn table's columns and types (FIXTURES section 1).
CHURN_SCHEMA = StructType([
    StructField("RowNumber", LongType()),
    StructField("CustomerId", LongType()),
    StructField("Surname", StringType()),
    StructField("CreditScore", IntegerType()),
    StructField("Geography", StringType()),
    StructField("Gender", StringType()),
    StructField("Age", IntegerType()),
    StructField("Tenure", IntegerType()),
    StructField("Balance", DoubleType()),
    StructField("NumOfProducts", IntegerType()),
    StructField("HasCrCard", IntegerType()),
    StructField("IsActiveMember", IntegerType()),
    StructField("EstimatedSalary", DoubleType()),
    StructField("Exited", IntegerType()),
    StructField("Complain", IntegerType()),
    StructField("Satisfaction Score", IntegerType()),
    StructField("Card Type", StringType()),
    StructField("Point Earned", IntegerType()),
])

REGISTRY_SCHEMA = StructType([
    StructField("selected_features", ArrayType(StringType())),
    StructField("nomod_columns", ArrayType(StringType())),
    StructField("dummyfy_columns", ArrayType(StringType())),
    StructField("norm_std_columns", ArrayType(StringType())),
])


def read_csv(spark: SparkSession, path: str, schema: StructType | str = CHURN_SCHEMA,
             mode: str = "FAILFAST") -> DataFrame:
    """CSV with a header and an explicit schema (no inference pass)."""
    return spark.read.schema(schema).option("header", True).option("mode", mode).csv(path)


def check_target(df: DataFrame, target: str, what: str = "table") -> None:
    """Raise when the target column is missing (analysis only, no job)."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found in {what}")


def write_splits(df: DataFrame, path: str, split_col: str = "split", fmt: str = "parquet",
                 mode: str = "overwrite") -> None:
    """One table partitioned by split (train/val/test directories)."""
    df.write.format(fmt).mode(mode).partitionBy(split_col).save(path)


def write_features_and_target(df: DataFrame, path: str, key: str, target: str,
                              split_col: str = "split", fmt: str = "parquet",
                              mode: str = "overwrite", header: bool = True) -> None:
    """Features and target of each split as separate tables, both keyed:
    ``{path}/features/split=...`` and ``{path}/target/split=...``.  With
    ``fmt='csv'`` a header row is written."""
    w_opts = {"header": str(header).lower()} if fmt == "csv" else {}
    feats = df.drop(target)
    tgt = df.select(key, target, split_col)
    feats.write.format(fmt).options(**w_opts).mode(mode).partitionBy(split_col).save(f"{path}/features")
    tgt.write.format(fmt).options(**w_opts).mode(mode).partitionBy(split_col).save(f"{path}/target")


def read_split(spark: SparkSession, path: str, split: str, fmt: str = "parquet") -> DataFrame:
    """One split of a table written by ``write_splits``; the partition
    filter prunes the other directories."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", False)
    return reader.load(path).where(F.col("split") == split)


def join_features_target(features: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Column-wise concatenation of features and target, by key."""
    return features.join(target, key, "inner")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The feature registry document as a one-row DataFrame."""
    return spark.read.schema(REGISTRY_SCHEMA).option("multiLine", True).json(path)


def registry_dict(registry: DataFrame) -> dict:
    """Registry row as a dict (four short name lists)."""
    row = registry.first()
    return {k: list(row[k] or []) for k in REGISTRY_SCHEMA.fieldNames()}


def write_registry(spark: SparkSession, registry: dict, path: str) -> None:
    spark.createDataFrame([tuple(registry.get(k, []) for k in REGISTRY_SCHEMA.fieldNames())],
                          REGISTRY_SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def report_records(report: DataFrame) -> DataFrame:
    """Drift report as one JSON record per feature."""
    return report.select(F.to_json(F.struct(*report.columns)).alias("record"))


def report_document(report: DataFrame) -> DataFrame:
    """One row: {"drift_detected": any, "report": [records...]} as JSON.
    The report has one row per tested feature (bounded by the schema)."""
    agg = report.agg(F.coalesce(F.bool_or("drift_detected"), F.lit(False)).alias("drift_detected"),
                     F.collect_list(F.struct(*report.columns)).alias("report"))
    return agg.select(F.to_json(F.struct("drift_detected", "report")).alias("document"))


def parse_document(text: str) -> dict:
    return json.loads(text)
