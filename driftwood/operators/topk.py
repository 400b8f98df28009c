"""Top rows per group without gathering a group into one task.

``row_number() over (partition by g order by ...)`` sends every row of a
group to one task; when one group holds a third of the table that task is
the job.  Top-1 is instead an aggregate (``min_by`` over a sort key), which
Spark combines map-side.  Top-k first keeps k rows per (group, salt) and
then ranks at most ``k x salts`` rows per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sort_key(order: list[tuple[str, str]]) -> Column:
    """Struct whose ascending order is the requested order; each item is
    (column, 'asc' | 'desc'); nulls always sort last."""
    parts = []
    for i, (c, direction) in enumerate(order):
        col = F.col(f"`{c}`")
        parts.append(col.isNull().alias(f"n{i}"))
        if direction == "desc":
            parts.append(F.when(col.isNotNull(), -col.cast("double")).alias(f"v{i}"))
        else:
            parts.append(col.alias(f"v{i}"))
    return F.struct(*parts)


def top1_per_group(df: DataFrame, group: list[str], order: list[tuple[str, str]]) -> DataFrame:
    """First row of each group in ``order`` (numeric desc keys; give a
    unique tie-break last).  Partial aggregation: one candidate per group
    per task before the shuffle."""
    cols = [c for c in df.columns if c not in group]
    row = F.struct(*[F.col(f"`{c}`") for c in cols])
    best = df.groupBy(*[F.col(f"`{g}`") for g in group]).agg(
        F.min_by(row, sort_key(order)).alias("_best"))
    return best.select(*[F.col(f"`{g}`") for g in group], "_best.*")


def top_k_per_group(df: DataFrame, group: list[str], order: list[tuple[str, str]], k: int,
                    salt_key: str, salts: int = 32) -> DataFrame:
    """k first rows of each group: rank inside (group, salt) buckets, keep
    k per bucket, then rank the survivors per group."""
    ordering = [F.col(f"`{c}`").desc_nulls_last() if d == "desc" else F.col(f"`{c}`").asc_nulls_last()
                for c, d in order]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(f"`{salt_key}`")), F.lit(salts)))
    w1 = Window.partitionBy(*group, "_salt").orderBy(*ordering)
    first = salted.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k)
    w2 = Window.partitionBy(*group).orderBy(*ordering)
    return first.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k) \
        .drop("_salt", "_r")


def cumulative_share(df: DataFrame, value: str, key: str) -> DataFrame:
    """Running sum of ``value`` in descending order and the share of the
    total (feature-importance style tables: one row per feature, so the
    whole table is small by construction)."""
    w = Window.orderBy(F.desc(value), F.asc(key)).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy()
    return df.select("*", F.sum(value).over(w).alias("cumulative"),
                     (F.col(value) / F.sum(value).over(total)).alias("relative"))
