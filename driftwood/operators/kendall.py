"""Kendall's tau-b of many column pairs without a pair of rows.

Rows become cells (pair, x, y) with a count.  Both axes are cut into range
buckets; two cells fall into one of three cases, and each is counted where it is
cheap:

* different buckets on both axes: from the table of bucket counts alone (prefix
  sums over at most ``MAX_BUCKETS``^2 numbers per column pair);
* the same x bucket: inside that bucket's stripe, by bits of the y rank (below);
* different x buckets but the same y bucket: inside that stripe, the x bucket
  taking the place of x.

Inside a stripe of m cells, concordant less discordant pairs come from log2(m)
passes over the bits of the rank: two ranks part at one bit, and there the one
with 0 is smaller, so running sums of the counts per common prefix say how much
comes before.  A stripe with one value on its axis has only ties and is left
out, whatever its size; a value that many cells share gets a bucket of its own,
so a hot value never makes a large stripe.  Stripes are otherwise of about equal
numbers of cells, and their number grows with the cells.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.operators.cumulative import bucket_column
from driftwood.session import cut_lineage, ship_package, shuffle_partitions

#: Cells of a stripe, about, and buckets of an axis at most.
STRIPE, MAX_BUCKETS = 250_000, 1_000


def agreement(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> int:
    """Sum of sign(a_i - a_j) sign(b_i - b_j) n_i n_j over all pairs."""
    rank = np.unique(b, return_inverse=True)[1].astype(np.int64)
    bits = max(1, int(rank.max()).bit_length()) if len(rank) else 0

    def ahead(ties_first: int) -> tuple[int, int]:
        """Pairs, in the order of a, that go up and that go down; equal a in
        the order of b (1) or against it (-1)."""
        order = np.lexsort((ties_first * rank, a))
        r, w = rank[order], n[order].astype(np.int64)
        up = down = 0
        for bit in range(bits - 1, -1, -1):
            group = r >> (bit + 1)
            by_group = np.argsort(group, kind="stable")
            g, one, v = group[by_group], (r[by_group] >> bit & 1).astype(bool), w[by_group]
            start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            size = np.diff(np.r_[start, len(g)])

            def before(x):  # running sum within the group, without the row itself
                total = np.cumsum(x) - x
                return total - np.repeat(total[start], size)

            up += int((v[one].astype(object) * before(np.where(one, 0, v))[one]).sum()) if one.any() else 0
            down += int((v[~one].astype(object) * before(np.where(one, v, 0))[~one]).sum()) if (~one).any() else 0
        return up, down

    if not bits:
        return 0
    return ahead(-1)[0] - ahead(1)[1]  # ties in a are counted in neither


def _splits(cells: DataFrame, axis: str, buckets: int) -> dict:
    """Split points per pair; a value that fills a bucket alone is parted from
    what follows."""
    ranks = [i / buckets for i in range(1, buckets)] or [0.5]
    rows = cells.groupBy("pair").agg(F.percentile_approx(axis, ranks, 20 * buckets).alias("s")).collect()  # a row per pair
    out = {}
    for r in rows:
        points = list(r["s"] or [])
        hot = {v for v, w in zip(points, points[1:]) if v == w}
        out[r["pair"]] = sorted({*points, *(math.nextafter(v, math.inf) for v in hot)})
    return out


def kendall(df: DataFrame, pairs: list[tuple[str, str]], buckets: int | None = None) -> DataFrame:
    """(col_a, col_b, corr) of the column pairs: tau-b over the rows where both
    columns have a value; null where a column is constant."""
    spark = df.sparkSession
    ship_package(spark)
    rows = F.array(*[F.struct(F.lit(i).alias("pair"), (F.col(f"`{a}`").cast("double") + F.lit(0.0)).alias("x"),
                              (F.col(f"`{b}`").cast("double") + F.lit(0.0)).alias("y")) for i, (a, b) in enumerate(pairs)])
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    cells = cut_lineage(df.select(F.inline(rows)).where(ok("x") & ok("y"))
                        .groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("n")))
    if buckets is None:
        size = cells.groupBy("pair").count().agg(F.max("count")).first()[0] or 0
        buckets = min(MAX_BUCKETS, max(shuffle_partitions(spark), math.ceil(size / STRIPE)))
    cells = cells.withColumn("bx", bucket_column(F.col("x"), _splits(cells, "x", buckets), "pair")) \
                 .withColumn("by", bucket_column(F.col("y"), _splits(cells, "y", buckets), "pair"))
    cells = cut_lineage(cells)
    grid = cells.groupBy("pair", "bx", "by").agg(F.sum("n").alias("n")).toPandas()  # at most buckets^2 per pair
    many = lambda axis: cells.groupBy("pair", "b" + axis).agg(F.min(axis).alias("lo"), F.max(axis).alias("hi")) \
        .where("lo < hi").select("pair", "b" + axis)

    def inside(first: str, second: str):
        def run(stripe: pd.DataFrame) -> pd.DataFrame:
            s = agreement(stripe[first].to_numpy(), stripe[second].to_numpy(), stripe["n"].to_numpy())
            return pd.DataFrame({"pair": [stripe["pair"].iloc[0]], "s": [str(s)]})
        return run

    in_x = cells.join(many("x"), ["pair", "bx"], "left_semi").groupBy("pair", "bx") \
        .applyInPandas(inside("x", "y"), "pair int, s string")
    in_y = cells.join(many("y"), ["pair", "by"], "left_semi").groupBy("pair", "by") \
        .applyInPandas(inside("bx", "y"), "pair int, s string")
    stripes = in_x.unionByName(in_y).groupBy("pair").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {r["pair"]: int(r["s"]) for r in stripes.collect()}  # a row per pair

    def tied(axis: str) -> dict:
        t = F.col("t").cast("decimal(19,0)")
        counts = cells.groupBy("pair", axis).agg(F.sum("n").alias("t"))
        return {r["pair"]: int(r["p"]) for r in counts.groupBy("pair").agg(
            (F.sum(t * (t - 1)) / 2).cast("decimal(38,0)").alias("p")).collect()}

    ties_x, ties_y = tied("x"), tied("y")
    out = []
    for i, (a, b) in enumerate(pairs):
        mine = grid[grid["pair"] == i]
        total = int(mine["n"].sum())
        whole = total * (total - 1) // 2
        scale = (whole - ties_x.get(i, 0)) * (whole - ties_y.get(i, 0))
        s = found.get(i, 0) + _between(mine)
        out.append((a, b, s / math.sqrt(scale) if scale > 0 else None))
    return spark.createDataFrame(out, "col_a string, col_b string, corr double")


def _between(grid: pd.DataFrame) -> int:
    """Pairs of cells in different buckets on both axes."""
    if not len(grid):
        return 0
    x, y = (np.unique(grid[c], return_inverse=True)[1] for c in ("bx", "by"))
    table = np.zeros((x.max() + 1, y.max() + 1), np.int64)
    np.add.at(table, (x, y), grid["n"].to_numpy())
    left = np.cumsum(table, axis=0) - table  # smaller x bucket, by y bucket
    below = np.cumsum(left, axis=1) - left
    above = left.sum(axis=1, keepdims=True) - left - below
    return int((table.astype(object) * (below - above)).sum())
