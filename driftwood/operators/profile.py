"""Table profiling: column summary, value counts, rates, crosstab,
histogram, box statistics, correlations, density estimate, argmax, pivot.

Every operator is one or two aggregation passes; per-column statistics of
many columns are computed in a single ``agg`` and then exploded to rows.
Scalars needed by a second pass (min/max, totals) are scalar subqueries
(``DataFrame.scalar()``), which Spark evaluates once and inlines.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwood.operators.selection import exact_quantiles


def column_profile(df: DataFrame, columns: list[str] | None = None,
                   approx_distinct: bool = False) -> DataFrame:
    """Type, non-null count, missing, % missing and distinct (nulls
    excluded) per column, ordered by distinct desc.

    One narrow (column, value) row per cell is counted with map-side partial
    sums, so no row is widened or copied whole; ``approx_distinct=True`` uses
    HyperLogLog++ in one aggregation without a shuffle of values.
    """
    cols = columns or df.columns
    types = dict(df.dtypes)
    if approx_distinct:
        stats = [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"),
                          F.count(F.col(f"`{c}`")).alias("non_null"),
                          F.approx_count_distinct(F.col(f"`{c}`")).alias("distinct")) for c in cols]
        per = df.agg(F.array(*stats).alias("_s")).select(F.inline("_s"))
    else:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), _as_key(F.col(f"`{c}`"), types[c]).alias("value"))
                          for c in cols])
        counted = df.select(F.inline(cells)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")  # one row per column
        per = names.join(counted, "column", "left").groupBy("column").agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"),
            F.count("value").alias("distinct"))
    kind = F.element_at(F.create_map(*[F.lit(x) for c in cols for x in (c, types[c])]), F.col("column"))
    missing = F.col("rows") - F.col("non_null")
    return (per.select("column", kind.alias("dtype"), "non_null", missing.alias("missing"),
                       F.when(F.col("rows") > 0, missing * 100.0 / F.col("rows")).otherwise(F.lit(0.0))
                       .alias("pct_missing"), "distinct")
            .orderBy(F.desc("distinct"), "column"))


def _as_key(col, dtype: str):
    """A value as text that is equal exactly for equal values."""
    if dtype in ("double", "float"):
        col = col + F.lit(0.0).cast(dtype)  # -0.0 becomes 0.0
    if dtype.startswith(("array", "map", "struct")):
        return F.to_json(col)
    return F.hex(col) if dtype == "binary" else col.cast("string")


def value_counts(df: DataFrame, column: str, normalize: bool = True) -> DataFrame:
    """Count per value (nulls excluded), with the share of non-null rows."""
    col = F.col(f"`{column}`")
    base = df.where(col.isNotNull())
    counts = base.groupBy(col.alias(column)).agg(F.count(F.lit(1)).alias("count"))
    if normalize:
        total = base.select(F.count(F.lit(1))).scalar()
        counts = counts.withColumn("proportion", F.col("count") / total)
    return counts.orderBy(F.desc("count"), column)


def rate_by_category(df: DataFrame, feature: str, target: str,
                     means: list[str] | None = None) -> DataFrame:
    """Mean target (e.g. churn rate) and row count per category, plus the
    mean of any ``means`` columns."""
    return (df.groupBy(F.col(f"`{feature}`").alias(feature))
            .agg(F.avg(F.col(f"`{target}`").cast("double")).alias("rate"),
                 F.count(F.lit(1)).alias("n"),
                 *[F.avg(F.col(f"`{m}`")).alias(f"mean_{m}") for m in (means or [])]))


def crosstab(df: DataFrame, row: str, column: str,
             values: list | None = None) -> DataFrame:
    """Counts of (row value, column value); one column per column value,
    missing combinations 0.  Null values are left out, as in pandas."""
    r, c = F.col(f"`{row}`"), F.col(f"`{column}`")
    base = df.where(r.isNotNull() & c.isNotNull())
    piv = base.groupBy(r.alias(row)).pivot(column, values).count()
    return piv.fillna(0, subset=[x for x in piv.columns if x != row])


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram over [min, max]; the last bin is closed.

    Output: bin (0-based), lo, hi, count, density = count / (n * width).
    Empty bins are included.
    """
    v = F.col(f"`{column}`").cast("double")
    base = df.select(v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    stats = base.agg(F.struct(F.min("_v").alias("mn"), F.max("_v").alias("mx"),
                              F.count(F.lit(1)).alias("n")).alias("s")).scalar()
    mn, mx, n = stats["mn"], stats["mx"], stats["n"]
    width = F.when(mx > mn, (mx - mn) / bins).otherwise(F.lit(1.0))
    idx = F.least(F.floor((F.col("_v") - mn) / width), F.lit(bins - 1)).cast("int")
    counts = base.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(F.broadcast(counts), "bin", "left")  # at most ``bins`` rows
            .select("bin",
                    (mn + F.col("bin") * width).alias("lo"),
                    (mn + (F.col("bin") + 1) * width).alias("hi"),
                    F.coalesce("count", F.lit(0)).alias("count"),
                    (F.coalesce("count", F.lit(0)) / (n * width)).alias("density")))


def box_stats(df: DataFrame, value: str, by: list[str] | None = None,
              whisker: float = 1.5) -> DataFrame:
    """q1, median, q3 (exact, linear interpolation), whiskers = furthest
    points within ``whisker`` * IQR of the box, and outlier count, from one
    row per distinct value."""
    by = list(by or [])
    v = F.col(f"`{value}`").cast("double")
    base = df.select(*[F.col(f"`{b}`").alias(b) for b in by], v.alias("_v")) \
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    q = exact_quantiles(base, "_v", [0.25, 0.5, 0.75], by=by) \
        .select(*by, F.col("q_0").alias("q1"), F.col("q_1").alias("median"),
                F.col("q_2").alias("q3"))
    base = base.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    if by:  # one quartile row per group, joined on the group key (a null group is one too)
        q = q.select(*[F.col(b).alias(f"_k_{b}") for b in by], "q1", "median", "q3")
        same = reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(f"_k_{b}")) for b in by])
        joined = base.join(q, same).select(*by, "_v", "_n", "q1", "median", "q3")
    else:   # one row: a scalar subquery, not a join
        s = q.select(F.struct("q1", "median", "q3").alias("s")).scalar()
        joined = base.select("_v", "_n", s["q1"].alias("q1"), s["median"].alias("median"),
                             s["q3"].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    lo_fence, hi_fence = F.col("q1") - whisker * iqr, F.col("q3") + whisker * iqr
    return joined.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(F.col("_v") >= lo_fence, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(F.col("_v") <= hi_fence, F.col("_v"))).alias("whisker_high"),
        F.sum(F.when((F.col("_v") < lo_fence) | (F.col("_v") > hi_fence), F.col("_n")).otherwise(0)).alias("outliers"),
        F.sum("_n").alias("n"))


def category_distribution_matrix(df: DataFrame, categorical: list[str],
                                 continuous: list[str], kind: str = "box") -> DataFrame:
    """Box statistics of every continuous column within every category of
    every categorical column (the data behind a violin/box/strip grid)."""
    if kind not in ("violin", "box", "strip"):
        raise ValueError("kind must be 'violin', 'box', or 'strip'")
    if not categorical or not continuous:
        raise ValueError("need at least one categorical and one continuous column")
    cats = F.array(*[F.struct(F.lit(c).alias("cat_col"),
                              F.col(f"`{c}`").cast("string").alias("category"))
                     for c in categorical])
    conts = F.array(*[F.struct(F.lit(c).alias("cont_col"),
                               F.col(f"`{c}`").cast("double").alias("value"))
                      for c in continuous])
    long = (df.select(F.inline(cats), conts.alias("_c"))
            .select("cat_col", "category", F.inline("_c")))
    return box_stats(long, "value", by=["cat_col", "category", "cont_col"])


def correlation_matrix(df: DataFrame, columns: list[str],
                       method: str = "pearson") -> DataFrame:
    """Lower triangle (i > j) of the correlation matrix as rows
    (col_a, col_b, corr).  Every pair uses the rows where both columns have
    a value; Spearman correlates the average ranks (ties share the mean rank)
    among those rows, Kendall is tau-b.
    """
    if method not in ("pearson", "spearman", "kendall"):
        raise ValueError("method must be 'pearson', 'spearman' or 'kendall'")
    data = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for j, b in enumerate(columns) if i > j]
    if method == "spearman":
        return _rank_correlations(data, pairs)
    if method == "kendall":
        from driftwood.operators.kendall import kendall
        return kendall(data, pairs)
    row = data.agg(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                 F.corr(a, b).alias("corr")) for a, b in pairs]).alias("_p"))
    return row.select(F.inline("_p"))


def _rank_correlations(data: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Spearman per pair from one row per distinct (pair, x, y): the ranks of
    x and of y come from running totals over distinct values, and only those
    counts are joined, never the rows themselves."""
    from driftwood.operators.cumulative import running_totals
    cells = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.lit(f"{i}").alias("pair"),
                               F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y"))
                      for i, (a, b) in enumerate(pairs)])
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    seen = (data.select(F.inline(cells)).where(ok("x") & ok("y"))
            .groupBy("pair", "col_a", "col_b", "x", "y").agg(F.count(F.lit(1)).alias("n")))

    def ranks(side: str) -> DataFrame:
        counts = seen.groupBy("pair", side).agg(F.sum("n").alias("_n"))
        total = running_totals(counts, ["pair"], side, ["_n"], domain="pair")
        # centred on the mean rank (N + 1) / 2, which keeps the sums small
        return total.select("pair", side, (F.col("cum__n") - (F.col("_n") - 1) / 2.0
                                           - (F.col("total__n") + 1) / 2.0).alias(f"r{side}"))

    both = seen.join(ranks("x"), ["pair", "x"]).join(ranks("y"), ["pair", "y"])
    n, rx, ry = F.col("n"), F.col("rx"), F.col("ry")
    out = both.groupBy("pair", "col_a", "col_b").agg(
        F.try_divide(F.sum(n * rx * ry), F.sqrt(F.sum(n * rx * rx)) * F.sqrt(F.sum(n * ry * ry))).alias("corr"))
    names = data.sparkSession.createDataFrame([(a, b) for a, b in pairs], "col_a string, col_b string")
    return names.join(out, ["col_a", "col_b"], "left").select("col_a", "col_b", "corr")


def gaussian_kde(df: DataFrame, column: str, grid_points: int = 200,
                 by: str | None = None, bandwidth: float | None = None,
                 tolerance: float | None = None) -> DataFrame:
    """Gaussian kernel density on an even grid over [min, max], Scott's
    bandwidth factor n^(-1/5) times the sample standard deviation.

    Exact: the sum runs over distinct values weighted by their counts;
    each distinct value contributes to every grid point in one projection
    and the contributions are summed with map-side partial aggregation
    (work = distinct values x grid points, no pairing of data rows).

    With ``tolerance`` rows are shared out between the two nearest points of a
    fine grid first (linear binning), and the sum runs over those: at most
    range / spacing of them, however many values there are, and rows leave a
    task as counts per point.  The density is off by less than ``tolerance``
    divided by the bandwidth: the kernel's second derivative is at most 0.3990 /
    bandwidth^3, and linear interpolation with spacing d errs by at most
    d^2 / 8 times that.
    """
    v = F.col(f"`{column}`").cast("double")
    # without ``by`` one group that the optimizer doesn't take for a constant,
    # which would make the joins below cross joins
    group = F.col(f"`{by}`").cast("string") if by else F.when(v.isNotNull(), "all")
    base = (df.select(group.alias("group"), v.alias("_v"))
            .where(F.col("group").isNotNull() & F.col("_v").isNotNull() & ~F.isnan("_v")))
    # one row per group; the grid spans the range of all groups, taken by a
    # window over that table (one row per class of ``by``)
    stats = base.groupBy("group").agg(F.count(F.lit(1)).alias("n"),
                                      F.stddev_samp("_v").alias("sd"),
                                      F.min("_v").alias("gmin"), F.max("_v").alias("gmax"))
    everything = Window.partitionBy()
    h = (F.lit(bandwidth) if bandwidth is not None
         else F.col("sd") * F.pow(F.col("n"), F.lit(-0.2)))
    params = stats.select(
        "group", "n", h.alias("h"), F.min("gmin").over(everything).alias("mn"),
        ((F.max("gmax").over(everything) - F.min("gmin").over(everything))
         / F.lit(max(grid_points - 1, 1))).alias("step"))
    if tolerance is None:
        distinct = base.groupBy("group", "_v").agg(F.count(F.lit(1)).alias("_w"))
    else:
        fine = F.col("h") * math.sqrt(8 * tolerance / 0.3990)
        at = (F.col("_v") - F.col("mn")) / fine
        near = base.join(params, "group").select("group", fine.alias("_d"), "mn", F.floor(at).alias("_k"),
                                                 (at - F.floor(at)).alias("_part"))
        shares = F.array(F.struct(F.col("_k").alias("k"), (1 - F.col("_part")).alias("w")),
                         F.struct((F.col("_k") + 1).alias("k"), F.col("_part").alias("w")))
        distinct = (near.select("group", "_d", "mn", F.inline(shares)).groupBy("group", "_d", "mn", "k")
                    .agg(F.sum("w").alias("_w")).select("group", (F.col("mn") + F.col("k") * F.col("_d")).alias("_v"), "_w"))
    with_p = distinct.join(params, "group")  # size-checked by Catalyst / AQE
    grid = F.sequence(F.lit(0), F.lit(grid_points - 1))
    contrib = with_p.select(
        "group", "n", "h", "mn", "step",
        F.posexplode(F.transform(grid, lambda i: F.col("_w") * F.exp(
            -0.5 * F.pow((F.col("mn") + i * F.col("step") - F.col("_v")) / F.col("h"), 2))))
        .alias("i", "c"))
    dens = contrib.groupBy("group", "i", "n", "h", "mn", "step").agg(F.sum("c").alias("s"))
    return dens.select("group", F.col("i").alias("point"),
                       (F.col("mn") + F.col("i") * F.col("step")).alias("x"),
                       (F.col("s") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi)))
                       .alias("density"))


def class_rate_change(reference: DataFrame, current: DataFrame, target: str) -> DataFrame:
    """Positive rate in each table, absolute change, relative change %."""
    ref = reference.select(F.avg(F.col(f"`{target}`").cast("double"))).scalar()
    cur = current.select(F.avg(F.col(f"`{target}`").cast("double"))).scalar()
    one = reference.sparkSession.range(1)
    return one.select(ref.alias("reference_positive_rate"),
                      cur.alias("current_positive_rate"),
                      (cur - ref).alias("absolute_change"),
                      (F.try_divide(cur - ref, ref) * 100.0).alias("relative_change_pct"))


def argmax_row(df: DataFrame, score: str, key: str) -> DataFrame:
    """The row with the highest score; ties go to the smallest key.
    Planned as a top-1 (TakeOrderedAndProject): one row kept per task."""
    return df.orderBy(F.desc_nulls_last(score), F.asc(key)).limit(1)


def pivot_scores(df: DataFrame, index: str, columns: list[str], value: str,
                 sep: str = "_", strict: bool = False) -> DataFrame:
    """One row per ``index``, one column per combination of ``columns``
    (joined by ``sep``; a null label is written ``null``, which keeps (a, null)
    and (null, a) apart), holding ``value``.  A repeated cell takes its first
    value, or with ``strict`` raises (pandas' pivot refuses duplicates; the
    check is one aggregation job)."""
    label = F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
    cells = df.select(F.col(index), label.alias("_label"), F.col(value))
    if strict:
        dup = cells.groupBy(index, "_label").count().where(F.col("count") > 1).limit(1).collect()
        if dup:
            raise ValueError(f"duplicate pivot cell: {dup[0][index]!r}, {dup[0]['_label']!r}")
    return (cells.groupBy(index).pivot("_label")
            .agg(F.first(value)))


def split_sizes(df: DataFrame, split: str = "split") -> DataFrame:
    """Row count per split and the column count, in one job."""
    ncols = len([c for c in df.columns if c != split])
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"),
                                 F.lit(ncols).alias("columns"))
