"""Splits keep the caller's columns, and the pivot keeps null labels."""

from pyspark.sql import functions as F

from driftwood.operators import profile as P
from driftwood.operators import splits as K

HELPERS = ["_b", "_y", "_h", "_k", "_r", "_row", "_before", "_after", "_t", "_tv", "_mixed", "_dw_b", "_DW__y", "_ny"]


def table(spark):
    return spark.range(300).select(
        F.col("id").alias("key"), (F.col("id") % 3).alias("label"),
        *[(F.col("id") * (i + 2)).alias(c) for i, c in enumerate(HELPERS)])


def check(out, extra):
    assert set(out.columns) == {"key", "label", *HELPERS, *extra}
    wrong = [F.col(c) != F.col("key") * (i + 2) for i, c in enumerate(HELPERS)]
    assert out.count() == 300
    for w in wrong:
        assert out.where(w).count() == 0


def test_split_keeps_columns_with_helper_names(spark):
    out = K.stratified_split(table(spark), "label", "key", .2, .2, bucket_bits=4)
    check(out, ["split"])
    assert {(r["split"], r["count"]) for r in out.groupBy("split").count().collect()} == {
        ("test", 60), ("val", 48), ("train", 192)}
    again = K.stratified_split(out, "label", "key", .5)  # takes the place of the column
    assert again.columns.count("split") == 1 and again.where("split = 'test'").count() == 150


def test_folds_and_ranks_keep_columns_with_helper_names(spark):
    check(K.stratified_folds(table(spark), "label", "key", 5), ["fold"])
    check(K.stratified_ranks(table(spark), "label", "key"), ["_rank", "_class_n"])


def test_split_by_a_label_with_a_helper_name(spark):
    df = table(spark).withColumn("_b", F.col("key") % 2).withColumn("_h", F.col("key"))
    out = K.stratified_split(df, "_b", "_h", .2)
    assert {(r["_b"], r["split"], r["count"]) for r in out.groupBy("_b", "split").count().collect()} == {
        (0, "test", 30), (1, "test", 30), (0, "train", 120), (1, "train", 120)}


def test_pivot_keeps_cells_with_null_labels(spark):
    df = spark.createDataFrame([(1, "a", None, .1), (1, None, "a", .2), (1, "a", "a", .3), (2, None, None, .4)],
                               "step int, model string, direction string, score double")
    out = P.pivot_scores(df, "step", ["model", "direction"], "score", strict=True)
    got = {r["step"]: r.asDict() for r in out.collect()}
    assert got[1] == {"step": 1, "a_null": .1, "null_a": .2, "a_a": .3, "null_null": None}
    assert got[2]["null_null"] == .4
