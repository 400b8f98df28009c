"""Feature and target drift between a reference and a current table.

All columns are tested in one pass per test type: both tables are unpivoted
to (feature, value, side) rows and unioned, so every numeric feature's KS
statistic comes from one aggregation + one bucketed running total, and every
categorical feature's chi-square from one aggregation.

* KS (numeric): D = max_x |F_ref(x) - F_cur(x)| over distinct values, nulls
  dropped; p-value from the asymptotic Kolmogorov series, the finite-n
  distribution or an exact count, as asked.
* Chi-square (categorical): category counts of both tables aligned
  (absent = 0), +1 added to every cell, 2 x K contingency test with
  dof = K - 1; Yates' continuity correction when dof = 1; K = 1 gives
  statistic 0 and p-value 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from driftwood.functions.stats import (chi2_prepare, chi2_sf_prepared, ks_finite_prepare, ks_finite_sf,
                                      ks_lambda, ks_sf_from_lambda)
from driftwood.operators.cumulative import running_totals

REPORT_COLUMNS = ["feature", "type", "metric_name", "metric_value", "p_value",
                  "drift_detected"]


def _present(ref: DataFrame, cur: DataFrame, cols: list[str]) -> list[str]:
    """Columns present in both tables (others are skipped, as documented)."""
    return [c for c in cols if c in ref.columns and c in cur.columns]


def _long(df: DataFrame, cols: list[str], side: int, as_type: str) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(c).alias("feature"),
                             F.col(f"`{c}`").cast(as_type).alias("value"))
                    for c in cols])
    return df.select(F.lit(side).alias("side"), F.inline(arr))


def ks_statistics(reference: DataFrame, current: DataFrame,
                  columns: list[str]) -> DataFrame:
    """feature, ks_stat, n_ref, n_cur for every numeric column."""
    cols = _present(reference, current, columns)
    if not cols:
        raise ValueError("no numeric column present in both tables")
    long = (_long(reference, cols, 0, "double").unionByName(_long(current, cols, 1, "double"))
            .where(F.col("value").isNotNull() & ~F.isnan("value")))
    per_value = long.groupBy("feature", "value").agg(
        F.count_if(F.col("side") == 0).alias("n0"),
        F.count_if(F.col("side") == 1).alias("n1"))
    return ks_from_counts(per_value, long)


def ks_from_counts(per_value: DataFrame, split_source: DataFrame | None = None) -> DataFrame:
    """feature, ks_stat, n_ref, n_cur from (feature, value, n0, n1), a row per
    distinct value with its rows on both sides."""
    cum = running_totals(per_value, ["feature"], "value", ["n0", "n1"], domain="feature",
                         split_source=split_source)
    gap = F.abs(F.col("cum_n0") / F.col("total_n0") - F.col("cum_n1") / F.col("total_n1"))
    return cum.groupBy("feature").agg(
        F.max(gap).alias("ks_stat"),
        F.first("total_n0").alias("n_ref"), F.first("total_n1").alias("n_cur"))


def ks_test(reference: DataFrame, current: DataFrame, columns: list[str],
            alpha: float = 0.05, p_method: str = "asymptotic") -> DataFrame:
    """KS rows of the drift report, by one stated method at every size.

    p_method: 'asymptotic' (Kolmogorov series, a SQL expression), 'finite' (the
    one-sample distribution at n = round(n_ref n_cur / (n_ref + n_cur)), a SQL
    expression good to 1e-6 at every size) or 'exact' (lattice-path probability
    from (D, n_ref, n_cur) alone, in a pandas UDF over the one-row-per-feature
    statistics).  The exact count follows the band of paths that stay below D:
    at most about n sqrt(n (ln 2n + 41)) / 2 cells at n = n_ref + n_cur rows, in one
    task per feature and in the memory of one diagonal; no size is refused."""
    return ks_rows(ks_statistics(reference, current, columns), alpha, p_method)


def ks_rows(s: DataFrame, alpha: float = 0.05, p_method: str = "asymptotic") -> DataFrame:
    """The report rows of (feature, ks_stat, n_ref, n_cur)."""
    if p_method not in ("asymptotic", "finite", "exact"):
        raise ValueError("p_method must be 'asymptotic', 'finite' or 'exact'")
    # lambda projected first: the series then refers to a plain column
    s = s.select("*", ks_lambda("ks_stat", "n_ref", "n_cur").alias("_lam"))
    asym = ks_sf_from_lambda("_lam", "ks_stat", "n_ref", "n_cur")
    if p_method == "asymptotic":
        p = asym
    elif p_method == "finite":
        s = s.select("*", *ks_finite_prepare("ks_stat", "n_ref", "n_cur"))
        p = ks_finite_sf("ks_stat", "n_ref", "n_cur")
    else:
        p = _ks_exact_udf(s.sparkSession)("ks_stat", "n_ref", "n_cur")
    return s.select(
        "feature", F.lit("numerical").alias("type"),
        F.lit("KS-Statistic").alias("metric_name"),
        F.col("ks_stat").alias("metric_value"),
        p.alias("p_value")
    ).withColumn("drift_detected", F.col("p_value") < alpha)


def _ks_exact_udf(spark):
    from driftwood.functions.udfs import ks_exact_p
    from driftwood.session import ship_package
    ship_package(spark)  # the UDF body runs in Python workers
    return ks_exact_p


def _category(col: str, numeric: bool):
    """A column as category text: numbers go through double, so that 0 and
    0.0 are one category; NaN is a missing value, as null is."""
    c = F.col(f"`{col}`")
    if not numeric:
        return c.cast("string")
    v = c.cast("double")
    v = F.when(~F.isnan(v), v + F.lit(0.0))  # -0.0 becomes 0.0
    return F.when(v == F.floor(v), F.format_string("%.0f", v)).otherwise(v.cast("string"))


def _numeric(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, (NumericType, BooleanType))


def aligned_counts(reference: DataFrame, current: DataFrame,
                   columns: list[str]) -> DataFrame:
    """feature, category, n_ref, n_cur over the union of categories of both
    tables; a category missing on one side counts 0.  Columns that are
    numeric (or boolean) on both sides are compared as numbers, others as
    text; nulls and NaN are left out."""
    cols = _present(reference, current, columns)
    as_number = {c: _numeric(reference, c) and _numeric(current, c) for c in cols}

    def long(df: DataFrame, side: int) -> DataFrame:
        arr = F.array(*[F.struct(F.lit(c).alias("feature"), _category(c, as_number[c]).alias("category"))
                        for c in cols])
        return df.select(F.lit(side).alias("side"), F.inline(arr))

    both = long(reference, 0).unionByName(long(current, 1)).where(F.col("category").isNotNull())
    return both.groupBy("feature", "category").agg(
        F.count_if(F.col("side") == 0).alias("n_ref"),
        F.count_if(F.col("side") == 1).alias("n_cur"))


def chi2_from_counts(counts: DataFrame, by: list[str], smoothing: float = 1.0,
                     yates: bool = True) -> DataFrame:
    """Chi-square statistic, dof and p-value per ``by`` group from a table
    of (by..., category, n_ref, n_cur).  Group totals come from an
    aggregation joined back, so a feature with very many categories is
    spread over tasks."""
    t = counts.select(*by, (F.col("n_ref") + smoothing).alias("o_ref"),
                      (F.col("n_cur") + smoothing).alias("o_cur"))
    totals = t.groupBy(*by).agg(F.sum("o_ref").alias("tot_ref"), F.sum("o_cur").alias("tot_cur"),
                                F.count(F.lit(1)).alias("n_cat"))
    t = t.join(totals, by)
    o_ref, o_cur = F.col("o_ref"), F.col("o_cur")
    col_tot = o_ref + o_cur
    grand = F.col("tot_ref") + F.col("tot_cur")
    e_ref = F.col("tot_ref") * col_tot / grand
    e_cur = F.col("tot_cur") * col_tot / grand

    def term(o, e):
        dev = F.abs(o - e)
        if yates:
            dev = F.when(F.col("n_cat") == 2, dev - F.least(F.lit(0.5), dev)).otherwise(dev)
        return dev * dev / e

    per = t.groupBy(*by).agg(F.sum(term(o_ref, e_ref) + term(o_cur, e_cur)).alias("stat"),
                             F.first("n_cat").alias("n_cat"))
    dof = F.col("n_cat") - 1
    stat = F.when(dof <= 0, F.lit(0.0)).otherwise(F.col("stat"))
    out = per.select(*by, stat.alias("chi2_stat"), dof.cast("int").alias("dof"))
    # inner values projected once so the tail formula refers to plain columns
    out = out.select("*", *chi2_prepare("chi2_stat", "dof"))
    return out.select(*by, "chi2_stat", "dof",
                      chi2_sf_prepared("chi2_stat", "dof").alias("p_value"))


def chi2_test(reference: DataFrame, current: DataFrame, columns: list[str],
              alpha: float = 0.05) -> DataFrame:
    """Chi-square rows of the drift report."""
    return chi2_rows(aligned_counts(reference, current, columns), alpha)


def chi2_rows(counts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The report rows of (feature, category, n_ref, n_cur)."""
    s = chi2_from_counts(counts, ["feature"])
    return s.select(
        "feature", F.lit("categorical").alias("type"),
        F.lit("Chi2-Statistic").alias("metric_name"),
        F.col("chi2_stat").alias("metric_value"), "p_value"
    ).withColumn("drift_detected", F.col("p_value") < alpha)


def feature_drift_report(reference: DataFrame, current: DataFrame,
                         numeric: list[str], categorical: list[str],
                         alpha: float = 0.05, p_method: str = "asymptotic") -> DataFrame:
    """KS rows for numeric columns, chi-square rows for categorical ones;
    columns absent from either table are skipped."""
    parts = []
    if _present(reference, current, numeric):
        parts.append(ks_test(reference, current, numeric, alpha, p_method))
    if _present(reference, current, categorical):
        parts.append(chi2_test(reference, current, categorical, alpha))
    if not parts:
        raise ValueError("no column to test")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*REPORT_COLUMNS)


def any_drift(report: DataFrame) -> DataFrame:
    """Global flag: one row, true when any feature drifted."""
    return report.agg(F.coalesce(F.bool_or("drift_detected"), F.lit(False))
                      .alias("drift_detected"))


def route_passthrough(df: DataFrame, columns: list[str]) -> DataFrame:
    """Classify passthrough columns: categorical when at most 2 distinct
    non-null values or all values in {0, 1}; else numerical.  One
    aggregation for all columns (exact distinct: an approximate count could
    misroute a column right at the limit)."""
    aggs = []
    for c in columns:
        v = F.col(f"`{c}`").cast("double")
        aggs.append(F.struct(
            F.lit(c).alias("feature"),
            F.count_distinct(F.when(~F.isnan(v), v)).alias("distinct"),
            F.coalesce(F.bool_and(F.when(v.isNotNull() & ~F.isnan(v), v.isin(0.0, 1.0))),
                       F.lit(True)).alias("binary")))
    row = df.agg(F.array(*aggs).alias("_a"))
    return row.select(F.inline("_a")).select(
        "feature",
        F.when((F.col("distinct") <= 2) | F.col("binary"), "categorical")
        .otherwise("numerical").alias("kind"))


def target_drift(reference: DataFrame, current: DataFrame, target: str,
                 current_target: str | None = None, alpha: float = 0.05) -> DataFrame:
    """One row: chi-square on the aligned class counts (+1 smoothing, Yates
    for two classes), positive rates, absolute and relative (%) change."""
    cur_t = current_target or target
    ref = reference.select(F.col(f"`{target}`").alias("y"))
    cur = current.select(F.col(f"`{cur_t}`").alias("y"))
    counts = aligned_counts(ref, cur, ["y"])
    chi = chi2_from_counts(counts, ["feature"])
    y = F.col("category").cast("double")
    mean = lambda n: F.try_divide(F.sum(y * F.col(n)), F.sum(F.when(y.isNotNull(), F.col(n))))
    rates = counts.groupBy("feature").agg(mean("n_ref").alias("ref_rate"), mean("n_cur").alias("cur_rate"))
    change = F.col("cur_rate") - F.col("ref_rate")
    return chi.join(rates, "feature").select(
        F.lit("Chi2-Statistic").alias("metric_name"),
        F.col("chi2_stat").alias("metric_value"),
        F.col("p_value"),
        (F.col("p_value") < alpha).alias("drift_detected"),
        F.col("ref_rate").alias("reference_positive_rate"),
        F.col("cur_rate").alias("current_positive_rate"),
        change.alias("absolute_change"),
        (F.try_divide(change, F.col("ref_rate")) * 100.0).alias("relative_change_pct"))


def pipeline_feature_drift(reference: DataFrame, current: DataFrame, layout,
                           categories: dict | None = None, scaler: str = "standard",
                           alpha: float = 0.05, dtype: str = "float",
                           p_method: str = "asymptotic", materialize: bool = True) -> DataFrame:
    """Drift of the model's inputs: both tables get the derived features and
    the preprocessing fitted on the reference (float32 like the model
    input); one-hot outputs are tested as categorical, scaled outputs as
    numerical, passthrough outputs routed by their cardinality in the
    reference; then the KS / chi-square report.

    With ``materialize`` the engineered inputs are persisted (memory and
    disk; lost blocks are recomputed from lineage) for the fit, routing and
    test jobs, the report (one row per output column) is computed once and
    the inputs are released."""
    from pyspark import StorageLevel

    from driftwood.functions.features import add_features, required_features
    from driftwood.operators import preprocess as E

    need = required_features(layout.columns)
    ref_f = add_features(reference, need, categories=categories)
    cur_f = add_features(current, need, categories=categories)
    if materialize:
        ref_f = ref_f.persist(StorageLevel.MEMORY_AND_DISK)
        cur_f = cur_f.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = E.fit(ref_f, layout, scaler)
        ref_t, cur_t = fitted.transform(ref_f, dtype=dtype), fitted.transform(cur_f, dtype=dtype)
        names = fitted.output_names()
        cat = [c for c in names if c.startswith("cat__")]
        num = [c for c in names if c.startswith("num__")]
        passthrough = [c for c in names if c.startswith("pass__")]
        if passthrough:
            for r in route_passthrough(ref_t, passthrough).collect():  # one row per column
                (cat if r["kind"] == "categorical" else num).append(r["feature"])
        report = feature_drift_report(ref_t, cur_t, num, cat, alpha, p_method)
        if not materialize:
            return report
        rows = report.collect()  # one row per output column
        return reference.sparkSession.createDataFrame(rows, report.schema)
    finally:
        if materialize:
            ref_f.unpersist()
            cur_f.unpersist()
