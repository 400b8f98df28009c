"""Exact running totals and order statistics without a global window.

``Window.orderBy(x)`` with no partition key moves every row into one task.
Instead the ordered domain is cut into range buckets (split points from
``percentile_approx``, like ``QuantileDiscretizer``), running sums are
computed inside each ``(group, bucket)`` window partition, and each bucket
is shifted by the total of the buckets before it.  The bucket-total table
has one row per (group, bucket); it is broadcast only when that count is
known to be at most ``BROADCAST_ROWS`` (no groups, or a group count taken
from the split-point aggregation), otherwise joined normally.  Results are
exact: buckets only decide which task does the work.

Callers pre-aggregate to one row per distinct ordered value first (partial
aggregation map-side), so a value repeated by a third of all rows becomes
one row per task before any shuffle.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.session import shuffle_partitions

_BUCKET = "_dw_bucket"
MAX_DOMAINS = 4096  # value domains (columns) of one call; more raise
BROADCAST_ROWS = 1_000_000  # largest bucket-offset table joined by broadcast


def _domain_key(domain: str | None) -> Column:
    return F.lit("all") if domain is None else \
        F.coalesce(F.concat(F.lit("="), F.col(domain).cast("string")), F.lit("null"))


def bucket_column(value: Column, splits: dict, domain: str | None = None) -> Column:
    """Monotone bucket id: the number of the domain's split points <= value,
    by binary search over constant sorted arrays (any number of them; the
    expression does not grow with it).  A null value has bucket -1: nulls
    come first, as in the window order."""
    key = "all".format if domain is None else (lambda d: "null" if d is None else f"={_as_text(d)}")
    points = {key(d): sorted({float(x) for x in v if x is not None}) for d, v in splits.items()}
    longest = max([1, *map(len, points.values())])
    arrays = F.from_json(F.lit(json.dumps(points)), "map<string,array<double>>")
    own = F.try_element_at(arrays, _domain_key(domain))
    steps = F.array(*[F.lit(1 << k) for k in range(longest.bit_length() - 1, -1, -1)])
    found = F.aggregate(steps, F.lit(0), lambda lo, step: F.when(
        value >= F.get(own, lo + step - 1), lo + step).otherwise(lo))
    return F.when(value.isNull(), F.lit(-1)).otherwise(found).cast("int")


def _as_text(d) -> str:
    """A domain value as Spark casts it to text."""
    return str(d).lower() if isinstance(d, bool) else str(d)


def range_splits(df: DataFrame, order: str, domain: str | None,
                 n_buckets: int, relative_error: float | None = None,
                 count_groups: list[str] | None = None) -> tuple[dict, int]:
    """Approximate quantile split points of ``order`` per domain value, and
    (when ``count_groups`` is given) an estimate of the number of distinct
    groups, from the same aggregation.

    The result has at most ``domains x n_buckets`` numbers and the number
    of domains is checked against ``MAX_DOMAINS``.
    """
    probs = [i / n_buckets for i in range(1, n_buckets)] if n_buckets > 1 else [0.5]
    accuracy = int(max(1000, 50 * n_buckets) if relative_error is None
                   else 1.0 / relative_error)
    aggs = [F.percentile_approx(F.col(order).cast("double"), probs, accuracy).alias("_dw_s")]
    if count_groups:
        aggs.append(F.approx_count_distinct(F.struct(*[F.col(c) for c in count_groups]))
                    .alias("_dw_g"))
    else:
        aggs.append(F.lit(1).alias("_dw_g"))
    if domain is None:
        row = df.agg(*aggs).first()
        out, groups = {None: sorted(set(row["_dw_s"] or []))}, int(row["_dw_g"] or 1)
    else:
        rows = df.groupBy(domain).agg(*aggs).limit(MAX_DOMAINS + 1).collect()
        if len(rows) > MAX_DOMAINS:
            raise ValueError(f"more than {MAX_DOMAINS} value domains in {domain!r}")
        out = {r[domain]: sorted(set(r["_dw_s"] or [])) for r in rows}
        groups = sum(int(r["_dw_g"] or 1) for r in rows)
    if n_buckets <= 1:
        out = {k: [] for k in out}
    return out, max(1, groups)


def _range_bucket(df: DataFrame, order: str, domain: str | None, n: int,
                  count_groups: list[str] | None):
    """(bucketing function df -> df with the bucket column, upper bound of
    the number of (group, bucket) pairs)."""
    splits, groups = range_splits(df, order, domain, n, count_groups=count_groups)
    buckets = sum(len(v) + 2 for v in splits.values())
    expr = bucket_column(F.col(order).cast("double"), splits, domain)
    return (lambda d: d.withColumn(_BUCKET, expr)), groups * max(1, buckets)


def running_totals(df: DataFrame, by: list[str], order: str,
                   measures: list[str], domain: str | None = None,
                   n_buckets: int | None = None,
                   bucket: Column | None = None,
                   tiebreak: list[str] | None = None,
                   agg: str = "sum", exclusive: bool = False,
                   split_source: DataFrame | None = None) -> DataFrame:
    """Add ``cum_<m>`` (inclusive running sum in ascending ``order`` within
    ``by``) and ``total_<m>`` (sum within ``by``) for each measure.

    ``df`` must hold one row per distinct (by, order).  A null group is a
    group; a null ``order`` comes before all others.  ``domain`` names the
    column among ``by`` whose values have separate value ranges (e.g. the
    feature name of an unpivoted table); split points are per domain.
    ``bucket`` may supply a ready monotone bucket expression instead (e.g. a
    hash prefix when ``order`` is a hash).  ``tiebreak`` columns order rows
    sharing an ``order`` value.  ``agg='max'`` gives running maxima;
    ``exclusive`` leaves the current row out (null before the first row).
    ``split_source`` (a table with the same ``order``/``domain`` columns,
    typically the raw rows before aggregation) lets the split points come
    from a scan without the aggregation's shuffle.
    """
    if agg not in ("sum", "max"):
        raise ValueError("agg must be 'sum' or 'max'")
    f = F.sum if agg == "sum" else F.max
    n = n_buckets or max(1, shuffle_partitions(df.sparkSession))
    offset_rows = None  # unknown for a caller-supplied bucket
    if bucket is None:
        src = split_source if split_source is not None else df
        extra = [c for c in by if c != domain and c in src.columns]
        if [c for c in by if c != domain and c not in src.columns]:
            extra = None  # groups not visible in the split source: bound unknown
        add_bucket, offset_rows = _range_bucket(src, order, domain, n, extra or None)
        if extra is None:
            offset_rows = None
    else:
        def add_bucket(d, _b=bucket):
            return d.withColumn(_BUCKET, _b)
    b = add_bucket(df)

    keys = list(by) + [_BUCKET]
    tot = b.groupBy(*keys).agg(*[f(m).alias(f"_bt_{m}") for m in measures])
    before = Window.partitionBy(*by).orderBy(_BUCKET) \
        .rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    zero = F.lit(0) if agg == "sum" else F.lit(None)
    offsets = tot.select(*keys, *[
        F.coalesce(f(f"_bt_{m}").over(before), zero).alias(f"_off_{m}")
        for m in measures], *[
        f(f"_bt_{m}").over(whole).alias(f"total_{m}") for m in measures])

    order_cols = [order] + list(tiebreak or [])
    within = Window.partitionBy(*keys).orderBy(*order_cols) \
        .rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow)
    ranked = b.select("*", *[f(m).over(within).alias(f"_in_{m}") for m in measures])
    # offsets has one row per (group, bucket).  Broadcast it only when that
    # count is known to be small; otherwise a plain equi-join, which
    # Catalyst / AQE size-check themselves
    small = offset_rows is not None and offset_rows <= BROADCAST_ROWS
    off = offsets.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                         *[c for c in offsets.columns if c not in keys])
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    out = ranked.join(F.broadcast(off) if small else off, same)

    def combine(m):
        inner, off = F.col(f"_in_{m}"), F.col(f"_off_{m}")
        if agg == "sum":
            return F.coalesce(inner, F.lit(0)) + off
        return F.greatest(inner, off)  # greatest skips nulls

    return out.select(
        *[c for c in df.columns],
        *[combine(m).alias(f"cum_{m}") for m in measures],
        *[F.col(f"total_{m}") for m in measures])


def exact_quantiles(df: DataFrame, value: str, probs: list[float],
                    by: list[str] | None = None, domain: str | None = None,
                    n_buckets: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (numpy/pandas default,
    DuckDB ``quantile_cont``), nulls ignored.

    By bucketed running totals of value counts; ``selection.exact_quantiles``
    moves less.  Returns one row per group with columns ``q_<i>`` for ``probs[i]``.  No
    group is ever gathered into one task: ranks come from bucketed running
    counts, and only the (at most 2 per probability) rows holding the
    target ranks are kept.
    """
    by = list(by or [])
    valid = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = valid.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    cum = running_totals(counts, by, value, ["_n"], domain=domain, n_buckets=n_buckets,
                         split_source=valid)
    # target ranks (0-based) for every probability: floor and ceil of (N-1)p
    targets = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(0).alias("hi"),
                 F.floor((F.col("total__n") - 1) * F.lit(p)).alias("r"),
                 ((F.col("total__n") - 1) * F.lit(p)).alias("h"))
        for i, p in enumerate(probs)] + [
        F.struct(F.lit(i).alias("i"), F.lit(1).alias("hi"),
                 F.ceil((F.col("total__n") - 1) * F.lit(p)).alias("r"),
                 ((F.col("total__n") - 1) * F.lit(p)).alias("h"))
        for i, p in enumerate(probs)])
    excl = F.col("cum__n") - F.col("_n")
    hits = cum.select(*by, F.col(value).cast("double").alias("_v"), F.explode(
        F.filter(targets, lambda t: (t["r"] >= excl) & (t["r"] < F.col("cum__n")))
    ).alias("t"))
    picked = hits.groupBy(*by, F.col("t.i").alias("i")).agg(
        F.max(F.when(F.col("t.hi") == 0, F.col("_v"))).alias("v_lo"),
        F.max(F.when(F.col("t.hi") == 1, F.col("_v"))).alias("v_hi"),
        F.max(F.col("t.h") - F.floor(F.col("t.h"))).alias("frac"))
    q = F.col("v_lo") + F.col("frac") * (F.col("v_hi") - F.col("v_lo"))
    wide = picked.groupBy(*by).agg(*[
        F.max(F.when(F.col("i") == i, q)).alias(f"q_{i}") for i in range(len(probs))])
    return wide
