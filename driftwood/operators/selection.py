"""Exact order statistics by radix refinement: histogram passes that move
counts, never values.

A pass deals the values that may hold a wanted rank to digits of a monotone
key and counts them per (group, digit) with the digit's smallest and largest
value; the counts are summed map-side, so a task hands on a row per digit it
has seen and not a row per value.  The digit that holds a rank is an interval
of values, closed by its extremes; the next pass looks at that interval only.

* First digit: sign, exponent and the eight leading bits of the fraction, as
  the floor of ``DIGITS_0`` times the binary logarithm.  It needs no look at
  the data, and there are at most about a million such digits per group,
  whatever the number of rows (a few thousand for most columns).
* Further digits: the place between an interval's extremes in ``DIGITS``
  parts.  A pass cuts an interval by that factor and always parts its extremes,
  so a double's 52 bits end within five passes.
* Once the open intervals of all groups hold at most ``FEW`` rows, the values
  in them are the last digits.

A rank is found as soon as its digit has one value or the rank is the digit's
first or last.  Columns of few values end in the first pass.  All groups (and,
in an unpivoted table, all columns) are refined together.  The open intervals
are broadcast only if there are at most ``BROADCAST_ROWS`` groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.operators.cumulative import BROADCAST_ROWS
from driftwood.session import cut_lineage

DIGITS_0, DIGITS = 256, 4096
#: Rows of the open intervals that are counted value by value.
FEW = 200_000
#: Rows of the state (groups x probabilities x 2) that pass through the driver.
SMALL = 10_000
#: Above 1074 * DIGITS_0, so that the exponent's digit stays positive.
_SHIFT = 300_000


def first_digit(x: Column) -> Column:
    """Monotone in x: equal values share a digit and a larger value never has
    a smaller one."""
    size = F.abs(x)
    level = F.when(size == float("inf"), 2 * _SHIFT).otherwise(
        F.floor(F.log2(size) * DIGITS_0).cast("int") + _SHIFT)
    return F.when(x == 0, 0).when(x > 0, level).otherwise(-level)


def next_digit(x: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.lit(DIGITS - 1), F.floor((x - lo) / (hi - lo) * DIGITS).cast("int"))


def _histogram(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "_dw_digit").agg(
        F.count(F.lit(1)).alias("_dw_n"), F.min("_dw_v").alias("_dw_lo"), F.max("_dw_v").alias("_dw_hi"))


def _before(keys: list[str]) -> Column:
    """Rows in smaller digits of the group."""
    w = Window.partitionBy(*keys).orderBy("_dw_digit").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("_dw_n").over(w), F.lit(0))


def _found(rank: Column) -> Column:
    """The value of a rank within a digit, null while it is open."""
    lo, hi = F.col("_dw_lo"), F.col("_dw_hi")
    return F.when((lo == hi) | (rank == 0), lo).when(rank == F.col("_dw_n") - 1, hi)


def _same(a: list[str], b: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b)])


def _refine(rows: DataFrame, state: DataFrame, by: list[str], groups: int, last: bool) -> DataFrame:
    """One more pass over the open intervals of ``state``."""
    inner = [f"_dw_by{i}" for i in range(len(by))]
    wanted = state.where("_dw_value is null").select(
        *[F.col(b).alias(i) for b, i in zip(by, inner)], F.col("_dw_lo").alias("_dw_start"),
        F.col("_dw_hi").alias("_dw_stop")).distinct()
    x, lo, hi = F.col("_dw_v"), F.col("_dw_start"), F.col("_dw_stop")
    near = rows.join(F.broadcast(wanted) if groups <= BROADCAST_ROWS else wanted,
                     _same(by, inner) & (lo <= x) & (x <= hi))
    keys = [*by, "_dw_start"]
    hist = _histogram(near.select(*keys, "_dw_v", (x if last else next_digit(x, lo, hi)).alias("_dw_digit")), keys)
    hist = hist.select(*[F.col(b).alias(i) for b, i in zip(by, inner)], "_dw_start", "_dw_n", "_dw_lo", "_dw_hi",
                       _before(keys).alias("_dw_below"))
    ranks = state.where("_dw_value is null").select(*by, "_dw_i", "_dw_high", "_dw_frac", "_dw_rank",
                                                    F.col("_dw_lo").alias("_dw_from"))
    rank = F.col("_dw_rank") - F.col("_dw_below")
    found = (ranks.join(hist, _same([*by, "_dw_from"], [*inner, "_dw_start"]))
             .where((rank >= 0) & (rank < F.col("_dw_n")))
             .select(*by, "_dw_i", "_dw_high", "_dw_frac", rank.alias("_dw_rank"), "_dw_n", "_dw_lo", "_dw_hi"))
    return state.where("_dw_value is not null").unionByName(
        found.withColumn("_dw_value", _found(F.col("_dw_rank"))))


def _settled(state: DataFrame, by: list[str]) -> tuple[DataFrame, int, int]:
    """The state worked out, the rows in its open intervals and their number.
    A small state passes through the driver in one job; a larger one (very many
    groups) goes to the checkpoint folder."""
    got = state.limit(SMALL + 1).collect()
    if len(got) <= SMALL:
        left = {(*(r[b] for b in by), r["_dw_lo"]): r["_dw_n"] for r in got if r["_dw_value"] is None}
        return state.sparkSession.createDataFrame(got, state.schema), sum(left.values()), len(left)
    state = cut_lineage(state)
    left = state.where("_dw_value is null").select(*by, "_dw_lo", "_dw_n").distinct() \
        .agg(F.sum("_dw_n"), F.count(F.lit(1))).first()
    return state, left[0] or 0, left[1]


def exact_quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None,
                    few: int = FEW) -> DataFrame:
    """Exact quantiles with linear interpolation (numpy/pandas default, DuckDB
    ``quantile_cont``): a row per group with columns ``q_<i>`` for
    ``probs[i]``.  Nulls and NaN are left out, a null group is a group, and a
    group without values has no row."""
    groups = list(by or [])
    x = F.col(value).cast("double") + F.lit(0.0)  # -0.0 becomes 0.0
    rows = df.select(*groups, x.alias("_dw_v")).where("_dw_v is not null and not isnan(_dw_v)")
    by = groups or ["_dw_all"]
    if not groups:
        rows = rows.withColumn("_dw_all", F.lit(0))
    total = F.sum("_dw_n").over(Window.partitionBy(*by))
    hist = _histogram(rows.withColumn("_dw_digit", first_digit(F.col("_dw_v"))), by) \
        .select("*", _before(by).alias("_dw_below"), total.alias("_dw_total"))
    place = lambda p: (F.col("_dw_total") - 1) * F.lit(float(p))
    targets = F.array(*[F.struct(
        F.lit(i).alias("i"), F.lit(high).alias("high"), (F.ceil(place(p)) if high else F.floor(place(p))).alias("r"),
        (place(p) - F.floor(place(p))).alias("frac")) for i, p in enumerate(probs) for high in (False, True)])
    state = hist.withColumn("_dw_t", F.explode(F.filter(targets, lambda t: (
        t["r"] >= F.col("_dw_below")) & (t["r"] < F.col("_dw_below") + F.col("_dw_n"))))) \
        .withColumn("_dw_rank", F.col("_dw_t.r") - F.col("_dw_below")) \
        .select(*by, F.col("_dw_t.i").alias("_dw_i"), F.col("_dw_t.high").alias("_dw_high"),
                F.col("_dw_t.frac").alias("_dw_frac"), "_dw_rank", "_dw_n", "_dw_lo", "_dw_hi",
                _found(F.col("_dw_rank")).alias("_dw_value"))
    while True:
        state, open_rows, intervals = _settled(state, by)
        if not intervals:
            break
        state = _refine(rows, state, by, intervals, open_rows <= few)
    low = [F.max(F.when((F.col("_dw_i") == i) & ~F.col("_dw_high"), F.col("_dw_value"))) for i in range(len(probs))]
    high = [F.max(F.when((F.col("_dw_i") == i) & F.col("_dw_high"), F.col("_dw_value"))) for i in range(len(probs))]
    frac = [F.max(F.when(F.col("_dw_i") == i, F.col("_dw_frac"))) for i in range(len(probs))]
    return state.groupBy(*by).agg(*[
        F.when(f == 0, lo).otherwise(lo + f * (hi - lo)).alias(f"q_{i}")
        for i, (lo, hi, f) in enumerate(zip(low, high, frac))]).drop("_dw_all")
