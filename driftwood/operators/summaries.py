"""Stored summaries of a table's features, for drift tests that don't read
the table again.

A summary has one row per feature and distinct value with its count, and, for
numeric features of more than about ``EXACT_VALUES`` distinct values, one row
with a KLL sketch instead.  Both merge: counts add up and sketches join, so
summaries written per day (or per file, or per micro-batch) make the summary of
any span of days, and a feature may be exact on some days and sketched on
others.

``report`` compares two summaries.  Where both are exact it gives the same
report as the two tables.  A sketch counts as ``POINTS`` equal shares of its
rows, each at the quantile in its middle; ``ks_error`` bounds what that can be
off: for each sketch its rank error and half a share, in proportion to the
rows that it stands for.

Columns: part columns (if any), feature, kind ('value', 'category', 'sketch'),
value, category, n, sketch.  Nulls and NaN are left out; categories of numeric
columns are written as numbers (1 for 1.0), as in the drift tests.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.operators import drift as D
from driftwood.session import cut_lineage

#: Distinct values of a numeric feature that are kept as they are, about.
EXACT_VALUES = 1_000_000
#: Size parameter of the sketches, and the normalised rank error that it stands
#: for with 99 % confidence (published for KLL: about 2.446 / k^0.9433).
KLL_K = 4_000
#: Shares that a sketch is taken apart into.
POINTS = 4_096
COLUMNS = ["feature", "kind", "value", "category", "n", "sketch"]


def rank_error(k: int = KLL_K) -> float:
    return 2.446 / k ** 0.9433


def _numbers(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(f"`{c}`").cast("double") + F.lit(0.0)).alias("value"))
                      for c in columns])
    return df.select(*[F.col(f"`{b}`").alias(b) for b in by], F.inline(cells)) \
        .where("value is not null and not isnan(value)")


def _shaped(df: DataFrame, by: list[str], kind: str, **columns: Column) -> DataFrame:
    """The summary's columns; those not given are null."""
    types = {"value": "double", "category": "string", "n": "long", "sketch": "binary"}
    return df.select(*by, "feature", F.lit(kind).alias("kind"), *[
        columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def summarise(df: DataFrame, numeric: list[str], categorical: list[str], by: list[str] | None = None,
              exact_values: int = EXACT_VALUES, k: int = KLL_K) -> DataFrame:
    """The summary of ``df``, one per combination of the part columns ``by``.
    Which features are sketched is decided for the table as a whole, from an
    approximate distinct count; columns that ``df`` lacks are skipped."""
    by = list(by or [])
    numeric = [c for c in numeric if c in df.columns]
    categorical = [c for c in categorical if c in df.columns]
    if not numeric and not categorical:
        raise ValueError("no column to summarise")
    parts = []
    if numeric:
        row = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(numeric)]).first()
        many = [c for i, c in enumerate(numeric) if row[f"d{i}"] > exact_values]
        few = [c for c in numeric if c not in many]
        if few:
            counts = _numbers(df, few, by).groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias("n"))
            parts.append(_shaped(counts, by, "value", value=F.col("value"), n=F.col("n")))
        if many:
            made = _numbers(df, many, by).groupBy(*by, "feature").agg(
                F.kll_sketch_agg_double("value", k).alias("sketch"), F.count(F.lit(1)).alias("n"))
            parts.append(_shaped(made, by, "sketch", n=F.col("n"), sketch=F.col("sketch")))
    if categorical:
        cells = F.array(*[F.struct(F.lit(c).alias("feature"), D._category(c, D._numeric(df, c)).alias("category"))
                          for c in categorical])
        counts = df.select(*[F.col(f"`{b}`").alias(b) for b in by], F.inline(cells)).where("category is not null") \
            .groupBy(*by, "feature", "category").agg(F.count(F.lit(1)).alias("n"))
        parts.append(_shaped(counts, by, "category", category=F.col("category"), n=F.col("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merge(*summaries: DataFrame) -> DataFrame:
    """One summary of all the rows that the given ones stand for (over all
    their parts)."""
    every = summaries[0].select(COLUMNS)
    for s in summaries[1:]:
        every = every.unionByName(s.select(COLUMNS))
    counts = every.where("kind <> 'sketch'").groupBy("feature", "kind", "value", "category").agg(F.sum("n").alias("n"))
    made = every.where("kind = 'sketch'").groupBy("feature").agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return (counts.select("feature", "kind", "value", "category", "n", F.lit(None).cast("binary").alias("sketch"))
            .unionByName(_shaped(made, [], "sketch", n=F.col("n"), sketch=F.col("sketch"))))


def write_summary(summary: DataFrame, path: str, by: list[str]) -> None:
    """Store a summary, a folder per part.  Parts that are written again take
    the place of the old ones, so replaying a day adds nothing.  A feature of
    a part is written by one task: its rows are bounded by ``EXACT_VALUES``."""
    (summary.repartition(*by, "feature").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*by).parquet(path))


def read_summary(spark: SparkSession, path: str, where: Column | str | None = None) -> DataFrame:
    """The merged summary of the stored parts (those that ``where`` picks:
    the others' files are not read)."""
    stored = spark.read.parquet(path)
    return merge(stored if where is None else stored.where(where))


def _sides(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Both summaries, marked by side, of the features that both have."""
    both = reference.select(F.lit(0).alias("side"), *COLUMNS).unionByName(
        current.select(F.lit(1).alias("side"), *COLUMNS))
    shared = both.groupBy("feature").agg(F.min("side").alias("a"), F.max("side").alias("b")).where("a < b")
    return both.join(shared.select("feature"), "feature", "left_semi")


def ks_from_summaries(reference: DataFrame, current: DataFrame, points: int = POINTS,
                      k: int = KLL_K) -> DataFrame:
    """feature, ks_stat, n_ref, n_cur, ks_error for every numeric feature of
    both merged summaries."""
    both = cut_lineage(_sides(reference, current).where("kind <> 'category'"))
    exact = both.where("kind = 'value'").select("feature", "side", "value", F.col("n").cast("double").alias("n"))
    # a sketch stands for as many equal shares of its rows, each at its middle
    middles = F.lit((np.arange(points) + 0.5) / points)
    shares = both.where("kind = 'sketch' and n > 0").select(
        "feature", "side", F.explode(F.kll_sketch_get_quantile_double("sketch", middles)).alias("value"),
        (F.col("n") / points).alias("n"))
    on = lambda side, c="n": F.sum(F.when(F.col("side") == side, F.col(c)).otherwise(0))
    every = exact if both.where("kind = 'sketch'").isEmpty() else exact.unionByName(shares)
    per_value = every.groupBy("feature", "value").agg(on(0).alias("n0"), on(1).alias("n1"))
    sketched = F.when(F.col("kind") == "sketch", F.col("n")).otherwise(0)
    rows = both.select("feature", "side", "n", sketched.alias("m")).groupBy("feature").agg(
        on(0).alias("n_ref"), on(1).alias("n_cur"), on(0, "m").alias("m0"), on(1, "m").alias("m1"))
    off = rank_error(k) + 0.5 / points
    return (D.ks_from_counts(per_value).select("feature", "ks_stat").join(rows, "feature")
            .select("feature", "ks_stat", "n_ref", "n_cur",
                    ((F.col("m0") / F.col("n_ref") + F.col("m1") / F.col("n_cur")) * off).alias("ks_error")))


def counts_from_summaries(reference: DataFrame, current: DataFrame) -> DataFrame:
    """feature, category, n_ref, n_cur of the categorical features of both."""
    n = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0))
    return _sides(reference, current).where("kind = 'category'").groupBy("feature", "category").agg(
        n(0).alias("n_ref"), n(1).alias("n_cur"))


def report(reference: DataFrame, current: DataFrame, alpha: float = 0.05, p_method: str = "asymptotic",
           points: int = POINTS, k: int = KLL_K) -> DataFrame:
    """The drift report of two merged summaries: ``drift.REPORT_COLUMNS`` for
    every feature that both have."""
    ks = ks_from_summaries(reference, current, points, k).drop("ks_error")
    return (D.ks_rows(ks, alpha, p_method)
            .unionByName(D.chi2_rows(counts_from_summaries(reference, current), alpha))
            .select(*D.REPORT_COLUMNS))
