"""Drift queries (D1-D8, J1, E9) on event halves and customer snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwood.functions.stats import FINITE_EXACT, chi2_sf_dof1_sql, chi2_sf_even_sql, ks_sf_sql, pelz_good_term_sql
from driftwood.operators import drift as D
from driftwood.operators import summaries as S
from driftwood.plans.catalog import query
from driftwood.plans.common import SPLIT_TS, event_halves, event_halves_sql, rounded
from driftwood.plans.customer360 import customer360, customer360_sql
from driftwood.plans.q_checks import _folder
from driftwood.sources.tables import table


def _ks_sql(shifted: bool) -> str:
    return f"""u AS (SELECT value, 0 AS side FROM ref WHERE value IS NOT NULL AND NOT isnan(value)
      UNION ALL SELECT value, 1 FROM cur WHERE value IS NOT NULL AND NOT isnan(value)),
pv AS (SELECT value, count(*) FILTER (WHERE side = 0) AS n0,
              count(*) FILTER (WHERE side = 1) AS n1 FROM u GROUP BY value),
c AS (SELECT sum(n0) OVER (ORDER BY value) AS c0, sum(n1) OVER (ORDER BY value) AS c1,
             sum(n0) OVER () AS t0, sum(n1) OVER () AS t1 FROM pv),
ks AS (SELECT 'value' AS feature, max(abs(c0 / t0 - c1 / t1)) AS d,
              CAST(any_value(t0) AS DOUBLE) AS n_ref, CAST(any_value(t1) AS DOUBLE) AS n_cur FROM c),
ks_rows AS (SELECT feature, 'numerical' AS type, 'KS-Statistic' AS metric_name,
                   d AS metric_value, {ks_sf_sql('d', 'n_ref', 'n_cur')} AS p_value FROM ks)"""


def _chi_sql(dof: int) -> str:
    p = chi2_sf_even_sql("stat", dof) if dof % 2 == 0 else chi2_sf_dof1_sql("stat")
    return f"""cats AS (SELECT event_type AS category,
                count(*) FILTER (WHERE side = 0) + 1 AS o_ref,
                count(*) FILTER (WHERE side = 1) + 1 AS o_cur
         FROM (SELECT event_type, 0 AS side FROM ref UNION ALL SELECT event_type, 1 FROM cur)
         WHERE event_type IS NOT NULL GROUP BY event_type),
tt AS (SELECT o_ref, o_cur, sum(o_ref) OVER () AS tot_ref, sum(o_cur) OVER () AS tot_cur FROM cats),
ex AS (SELECT o_ref, o_cur, tot_ref * (o_ref + o_cur) / (tot_ref + tot_cur) AS e_ref,
              tot_cur * (o_ref + o_cur) / (tot_ref + tot_cur) AS e_cur FROM tt),
ch AS (SELECT 'event_type' AS feature,
              sum(pow(o_ref - e_ref, 2) / e_ref + pow(o_cur - e_cur, 2) / e_cur) AS stat FROM ex),
chi_rows AS (SELECT feature, 'categorical' AS type, 'Chi2-Statistic' AS metric_name,
                    stat AS metric_value, {p} AS p_value FROM ch)"""


def _final(rows: str) -> str:
    return f"""SELECT feature, type, metric_name, round(metric_value, 6) AS metric_value,
       round(p_value, 6) AS p_value, p_value < 0.05 AS drift_detected FROM {rows}"""


@query("ks_events_value", oracle=f"WITH {event_halves_sql()},\n{_ks_sql(False)}\n{_final('ks_rows')}")
def ks_events_value(spark, sf_dir):
    ref, cur = event_halves(spark, sf_dir)
    return rounded(D.ks_test(ref, cur, ["value"]))


@query("ks_events_value_exact")
def ks_events_value_exact(spark, sf_dir):
    """Exact two-sided p-value of the two halves' values, at any
    size.  No SQL twin."""
    ref, cur = event_halves(spark, sf_dir)
    return rounded(D.ks_test(ref, cur, ["value"], p_method="exact"))


@query("ks_daily_counts_exact")
def ks_daily_counts_exact(spark, sf_dir):
    """Exact two-sided p-value of daily event counts per type: a row per day
    and type, so it is within reach at any number of events.  No SQL twin."""
    ref, cur = _daily_halves(spark, sf_dir)
    return rounded(D.ks_test(ref, cur, ["value"], p_method="exact"))


def _daily_halves(spark, sf_dir):
    daily = (table(spark, sf_dir, "events", ["ts", "event_type"])
             .groupBy("event_type", F.to_date("ts").alias("day"))
             .agg(F.count("*").cast("double").alias("value")))
    split = F.lit(SPLIT_TS).cast("date")
    return daily.where(F.col("day") < split), daily.where(F.col("day") >= split)


#: The finite-n distribution from (d, n), written with tools that the Spark
#: expression doesn't use: lgamma in the tail, a recursive query for powers.
_FINITE_SQL = f"""
fin AS (SELECT feature, d, greatest(1.0, round_even(n_ref * n_cur / (n_ref + n_cur), 0)) AS n FROM ks),
par AS (SELECT feature, d, n, sqrt(n) * d AS z, CAST(floor(n * d) AS INTEGER) + 1 AS k FROM fin),
mat AS (SELECT feature, n, k, 2 * k - 1 AS m, k - n * d AS h FROM par WHERE n <= {FINITE_EXACT} AND z * z < 2.2),
big_h AS (SELECT feature, n, k, m, list_transform(range(0, m), lambda i: list_transform(range(0, m), lambda j:
            CASE WHEN i - j + 1 < 0 THEN 0.0 ELSE (1.0 - CASE WHEN j = 0 THEN pow(h, i + 1) ELSE 0.0 END
              - CASE WHEN i = m - 1 THEN pow(h, m - j) ELSE 0.0 END
              + CASE WHEN i = m - 1 AND j = 0 AND 2 * h > 1 THEN pow(2 * h - 1, m) ELSE 0.0 END)
              / gamma(i - j + 2.0) END)) AS rows FROM mat),
steps AS (
  WITH RECURSIVE r AS (
    SELECT feature, 0 AS s, list_transform(range(1, m + 1), lambda i: CASE WHEN i = k THEN 1.0::DOUBLE ELSE 0.0 END) AS v
    FROM big_h
    UNION ALL
    SELECT r.feature, r.s + 1, list_transform(b.rows, lambda x: list_dot_product(x, r.v) * (r.s + 1) / b.n)
    FROM r JOIN big_h b ON r.feature = b.feature WHERE r.s < b.n)
  SELECT r.feature, r.v[b.k] AS inside FROM r JOIN big_h b ON r.feature = b.feature AND r.s = b.n),
fin_rows AS (
  SELECT p.feature, 'numerical' AS type, 'KS-Statistic' AS metric_name, d AS metric_value,
         CASE WHEN d <= 1 / (2 * n) OR z < 0.2 THEN 1.0 WHEN d >= 1 THEN 0.0 ELSE least(1.0, greatest(0.0,
           CASE WHEN inside IS NOT NULL THEN 1 - inside
                WHEN n <= {FINITE_EXACT} THEN 2 * d * list_sum(list_transform(range(0, CAST(floor(n * (1 - d)) AS INTEGER) + 1),
                  lambda j: CASE WHEN 1 - d - j / n <= 0 THEN 0.0 ELSE exp(lgamma(n + 1) - lgamma(j + 1.0) - lgamma(n - j + 1)
                    + (j - 1) * ln(d + j / n) + (n - j) * ln(1 - d - j / n)) END))
                WHEN z >= 5 THEN 2 * exp(-pow(6 * n * d + 1, 2) / (18 * n))
                ELSE 1 - list_sum(list_transform(range(0, 20), lambda k: {pelz_good_term_sql('k', 'n', 'z')})) END)) END AS p_value
  FROM par p LEFT JOIN steps ON p.feature = steps.feature)"""

_DAILY_SQL = f"""daily AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS value
                FROM events GROUP BY ALL),
ref AS (SELECT value FROM daily WHERE day < DATE '{SPLIT_TS[:10]}'),
cur AS (SELECT value FROM daily WHERE day >= DATE '{SPLIT_TS[:10]}')"""


@query("ks_events_value_finite", oracle=f"WITH {event_halves_sql()},\n{_ks_sql(False)},{_FINITE_SQL}\n{_final('fin_rows')}")
def ks_events_value_finite(spark, sf_dir):
    ref, cur = event_halves(spark, sf_dir)
    return rounded(D.ks_test(ref, cur, ["value"], p_method="finite"))


@query("ks_daily_counts_finite", oracle=f"WITH {_DAILY_SQL},\n{_ks_sql(False)},{_FINITE_SQL}\n{_final('fin_rows')}")
def ks_daily_counts_finite(spark, sf_dir):
    """The small case: a row per day and event type."""
    ref, cur = _daily_halves(spark, sf_dir)
    return rounded(D.ks_test(ref, cur, ["value"], p_method="finite"))


@query("li_ks_price_finite", oracle=f"""WITH ref AS (SELECT CAST(l_extendedprice AS DOUBLE) AS value FROM lineitem
  WHERE l_returnflag = 'R'),
cur AS (SELECT CAST(l_extendedprice AS DOUBLE) AS value FROM lineitem WHERE l_returnflag <> 'R'),
{_ks_sql(False)},{_FINITE_SQL}
{_final('fin_rows')}""")
def li_ks_price_finite(spark, sf_dir):
    """Beyond the reach of an exact count: about sf x 6 million rows."""
    li = table(spark, sf_dir, "lineitem", ["l_extendedprice", "l_returnflag"]) \
        .select(F.col("l_extendedprice").cast("double").alias("value"), "l_returnflag")
    returned = F.col("l_returnflag") == "R"
    return rounded(D.ks_test(li.where(returned), li.where(~returned), ["value"], p_method="finite"))


@query("chi2_events_type", oracle=f"WITH {event_halves_sql()},\n{_chi_sql(4)}\n{_final('chi_rows')}")
def chi2_events_type(spark, sf_dir):
    ref, cur = event_halves(spark, sf_dir)
    return rounded(D.chi2_test(ref, cur, ["event_type"]))


@query("drift_report_events", oracle=f"""WITH {event_halves_sql()},
{_ks_sql(False)},
{_chi_sql(4)},
all_rows AS (SELECT * FROM ks_rows UNION ALL SELECT * FROM chi_rows)
{_final('all_rows')}""")
def drift_report_events(spark, sf_dir):
    ref, cur = event_halves(spark, sf_dir)
    return rounded(D.feature_drift_report(ref, cur, ["value", "missing_col"],
                                          ["event_type", "other_missing"]))


@query("drift_report_events_shifted", oracle=f"""WITH {event_halves_sql(True)},
{_ks_sql(True)},
{_chi_sql(4)},
all_rows AS (SELECT * FROM ks_rows UNION ALL SELECT * FROM chi_rows)
{_final('all_rows')}""")
def drift_report_events_shifted(spark, sf_dir):
    ref, cur = event_halves(spark, sf_dir, shifted=True)
    return rounded(D.feature_drift_report(ref, cur, ["value"], ["event_type"]))


@query("any_drift_events_shifted", oracle=f"""WITH {event_halves_sql(True)},
{_ks_sql(True)},
{_chi_sql(4)},
all_rows AS (SELECT p_value < 0.05 AS d FROM ks_rows UNION ALL SELECT p_value < 0.05 FROM chi_rows)
SELECT coalesce(bool_or(d), false) AS drift_detected FROM all_rows""")
def any_drift_events_shifted(spark, sf_dir):
    ref, cur = event_halves(spark, sf_dir, shifted=True)
    return D.any_drift(D.feature_drift_report(ref, cur, ["value"], ["event_type"]))


@query("aligned_counts_events_shifted", oracle=f"""WITH {event_halves_sql(True)}
SELECT 'event_type' AS feature, event_type AS category,
       count(*) FILTER (WHERE side = 0) AS n_ref, count(*) FILTER (WHERE side = 1) AS n_cur
FROM (SELECT event_type, 0 AS side FROM ref UNION ALL SELECT event_type, 1 FROM cur)
WHERE event_type IS NOT NULL GROUP BY event_type""")
def aligned_counts_events_shifted(spark, sf_dir):
    ref, cur = event_halves(spark, sf_dir, shifted=True)
    return D.aligned_counts(ref, cur, ["event_type"])


@query("target_drift_exited", oracle=f"""WITH {customer360_sql("2000-01-01", "ref0")},
{customer360_sql("2001-01-01", "cur0")},
cats AS (SELECT y, count(*) FILTER (WHERE side = 0) + 1 AS o_ref, count(*) FILTER (WHERE side = 1) + 1 AS o_cur
         FROM (SELECT Exited AS y, 0 AS side FROM ref0 UNION ALL SELECT Exited, 1 FROM cur0)
         WHERE y IS NOT NULL GROUP BY y),
tt AS (SELECT o_ref, o_cur, sum(o_ref) OVER () AS tot_ref, sum(o_cur) OVER () AS tot_cur FROM cats),
dev AS (SELECT abs(o_ref - tot_ref * (o_ref + o_cur) / (tot_ref + tot_cur)) AS d_ref,
               tot_ref * (o_ref + o_cur) / (tot_ref + tot_cur) AS e_ref,
               abs(o_cur - tot_cur * (o_ref + o_cur) / (tot_ref + tot_cur)) AS d_cur,
               tot_cur * (o_ref + o_cur) / (tot_ref + tot_cur) AS e_cur FROM tt),
ch AS (SELECT sum(pow(d_ref - least(0.5, d_ref), 2) / e_ref
                + pow(d_cur - least(0.5, d_cur), 2) / e_cur) AS stat FROM dev),
rates AS (SELECT (SELECT avg(Exited) FROM ref0) AS a, (SELECT avg(Exited) FROM cur0) AS b)
SELECT 'Chi2-Statistic' AS metric_name, round(stat, 6) AS metric_value,
       round({chi2_sf_dof1_sql('stat')}, 6) AS p_value,
       {chi2_sf_dof1_sql('stat')} < 0.05 AS drift_detected,
       round(a, 6) AS reference_positive_rate, round(b, 6) AS current_positive_rate,
       round(b - a, 6) AS absolute_change, round((b - a) / a * 100.0, 6) AS relative_change_pct
FROM ch, rates""")
def target_drift_exited(spark, sf_dir):
    ref = customer360(spark, sf_dir, cutoff="2000-01-01")
    cur = customer360(spark, sf_dir, cutoff="2001-01-01")
    return rounded(D.target_drift(ref, cur, "Exited"))


def _labels_by_half(spark, sf_dir):
    """Quality labels of even and odd documents: as int on the one side and
    as double with NaN and null on the other."""
    labels = table(spark, sf_dir, "labels", ["doc_id", "quality"])
    ref = labels.where(F.col("doc_id") % 2 == 0).select(F.col("quality").alias("y"))
    missing = F.when(F.col("doc_id") % 7 == 0, F.lit(float("nan"))).when(F.col("doc_id") % 11 != 0, F.col("quality"))
    cur = labels.where(F.col("doc_id") % 2 == 1).select(missing.cast("double").alias("y"))
    return ref, cur


@query("target_drift_mixed_types", oracle=f"""WITH ref AS (
  SELECT CAST(quality AS DOUBLE) AS y FROM labels WHERE doc_id % 2 = 0 AND quality IS NOT NULL),
cur AS (SELECT CAST(quality AS DOUBLE) AS y FROM labels
        WHERE doc_id % 2 = 1 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND quality IS NOT NULL),
cats AS (SELECT y, count(*) FILTER (WHERE side = 0) + 1 AS o_ref, count(*) FILTER (WHERE side = 1) + 1 AS o_cur
         FROM (SELECT y, 0 AS side FROM ref UNION ALL SELECT y, 1 FROM cur) GROUP BY y),
tt AS (SELECT *, sum(o_ref) OVER () AS tot_ref, sum(o_cur) OVER () AS tot_cur FROM cats),
ex AS (SELECT o_ref, o_cur, tot_ref * (o_ref + o_cur) / (tot_ref + tot_cur) AS e_ref,
              tot_cur * (o_ref + o_cur) / (tot_ref + tot_cur) AS e_cur FROM tt),
ch AS (SELECT sum(pow(abs(o_ref - e_ref) - least(0.5, abs(o_ref - e_ref)), 2) / e_ref
                  + pow(abs(o_cur - e_cur) - least(0.5, abs(o_cur - e_cur)), 2) / e_cur) AS stat FROM ex),
r AS (SELECT (SELECT avg(y) FROM ref) AS a, (SELECT avg(y) FROM cur) AS b)
SELECT 'Chi2-Statistic' AS metric_name, round(stat, 6) AS metric_value,
       round({chi2_sf_dof1_sql('stat')}, 6) AS p_value, {chi2_sf_dof1_sql('stat')} < 0.05 AS drift_detected,
       round(a, 6) AS reference_positive_rate, round(b, 6) AS current_positive_rate,
       round(b - a, 6) AS absolute_change, round((b - a) / a * 100.0, 6) AS relative_change_pct FROM ch, r""")
def target_drift_mixed_types(spark, sf_dir):
    ref, cur = _labels_by_half(spark, sf_dir)
    return rounded(D.target_drift(ref, cur, "y"))


ROUTE_COLUMNS = ["HasCrCard", "IsActiveMember", "NumOfProducts", "Tenure", "Age", "Balance"]


@query("route_passthrough", oracle=f"""WITH {customer360_sql()}
""" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS feature, CASE WHEN count(DISTINCT CAST({c} AS DOUBLE)) <= 2
       OR coalesce(bool_and(CAST({c} AS DOUBLE) IN (0.0, 1.0)), true)
       THEN 'categorical' ELSE 'numerical' END AS kind FROM customer360""" for c in ROUTE_COLUMNS))
def route_passthrough(spark, sf_dir):
    return D.route_passthrough(customer360(spark, sf_dir), ROUTE_COLUMNS)


# --- pipeline-aware drift: model inputs of two customer snapshots -------------

def _pipeline_drift_sql() -> str:
    from driftwood.functions.features import required_features
    from driftwood.operators import preprocess as E
    from driftwood.plans.q_features import FEATURE_SQL
    from driftwood.plans.q_preprocess import REGISTRY, SEGMENTS
    layout = E.layout_from_registry(REGISTRY)
    feats = required_features(layout.columns)
    fcols = ", ".join(f"{FEATURE_SQL[f]} AS {f}" for f in feats)
    stats = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS a_{c}, "
                      f"coalesce(nullif(stddev_pop(CAST({c} AS DOUBLE)), 0), 1) AS b_{c}"
                      for c in layout.scaled)
    cats = [("Card Type", v) for v in SEGMENTS[1:]] + [("Gender", "Male")]
    cat_cols = [f'CAST(CASE WHEN "{c}" = \'{v}\' THEN 1.0 ELSE 0.0 END AS FLOAT) AS "cat__{c}_{v}"'
                for c, v in cats]
    num_cols = [f"CAST((CAST({c} AS DOUBLE) - a_{c}) / b_{c} AS FLOAT) AS num__{c}" for c in layout.scaled]
    pas_cols = [f"CAST({c} AS FLOAT) AS pass__{c}" for c in layout.passthrough]
    sel = ", ".join(cat_cols + num_cols + pas_cols)
    cat_names = [f"cat__{c}_{v}" for c, v in cats] + [f"pass__{c}" for c in layout.passthrough]
    num_names = [f"num__{c}" for c in layout.scaled]
    lg_num = " UNION ALL ".join(
        f"SELECT '{n}' AS feature, CAST(\"{n}\" AS DOUBLE) AS value, side FROM t WHERE \"{n}\" IS NOT NULL"
        for n in num_names)
    lg_cat = " UNION ALL ".join(
        f"SELECT '{n}' AS feature, CAST(\"{n}\" AS VARCHAR) AS category, side FROM t WHERE \"{n}\" IS NOT NULL"
        for n in cat_names)
    return f"""WITH {customer360_sql("2000-01-01", "ref0")},
{customer360_sql("2001-01-01", "cur0")},
rf AS (SELECT *, {fcols} FROM ref0),
cf AS (SELECT *, {fcols} FROM cur0),
s AS (SELECT {stats} FROM rf),
t AS (SELECT 0 AS side, {sel} FROM rf, s UNION ALL SELECT 1 AS side, {sel} FROM cf, s),
lg AS ({lg_num}),
pv AS (SELECT feature, value, count(*) FILTER (WHERE side = 0) AS n0, count(*) FILTER (WHERE side = 1) AS n1
       FROM lg WHERE NOT isnan(value) GROUP BY feature, value),
c AS (SELECT feature, sum(n0) OVER (PARTITION BY feature ORDER BY value) AS c0,
             sum(n1) OVER (PARTITION BY feature ORDER BY value) AS c1,
             sum(n0) OVER (PARTITION BY feature) AS t0, sum(n1) OVER (PARTITION BY feature) AS t1 FROM pv),
ks AS (SELECT feature, max(abs(c0 / t0 - c1 / t1)) AS d, CAST(any_value(t0) AS DOUBLE) AS n_ref,
              CAST(any_value(t1) AS DOUBLE) AS n_cur FROM c GROUP BY feature),
cl AS ({lg_cat}),
cats AS (SELECT feature, category, count(*) FILTER (WHERE side = 0) + 1 AS o_ref,
                count(*) FILTER (WHERE side = 1) + 1 AS o_cur FROM cl GROUP BY feature, category),
tt AS (SELECT *, sum(o_ref) OVER (PARTITION BY feature) AS tot_ref,
              sum(o_cur) OVER (PARTITION BY feature) AS tot_cur,
              count(*) OVER (PARTITION BY feature) AS k FROM cats),
ex AS (SELECT feature, k, abs(o_ref - tot_ref * (o_ref + o_cur) / (tot_ref + tot_cur)) AS d_ref,
              tot_ref * (o_ref + o_cur) / (tot_ref + tot_cur) AS e_ref,
              abs(o_cur - tot_cur * (o_ref + o_cur) / (tot_ref + tot_cur)) AS d_cur,
              tot_cur * (o_ref + o_cur) / (tot_ref + tot_cur) AS e_cur FROM tt),
ch AS (SELECT feature, any_value(k) AS k,
              CASE WHEN any_value(k) = 1 THEN 0.0 ELSE
              sum(pow(d_ref - least(0.5, d_ref), 2) / e_ref + pow(d_cur - least(0.5, d_cur), 2) / e_cur) END AS stat
       FROM ex GROUP BY feature),
chp AS (SELECT feature, stat, CASE WHEN k = 1 THEN 1.0 ELSE {chi2_sf_dof1_sql('stat')} END AS p FROM ch)
SELECT feature, 'numerical' AS type, 'KS-Statistic' AS metric_name, round(d, 6) AS metric_value,
       round({ks_sf_sql('d', 'n_ref', 'n_cur')}, 6) AS p_value,
       {ks_sf_sql('d', 'n_ref', 'n_cur')} < 0.05 AS drift_detected FROM ks
UNION ALL
SELECT feature, 'categorical', 'Chi2-Statistic', round(stat, 6), round(p, 6), p < 0.05 FROM chp"""


@query("pipeline_drift_snapshots", oracle=_pipeline_drift_sql())
def pipeline_drift_snapshots(spark, sf_dir):
    from driftwood.operators import preprocess as E
    from driftwood.plans.customer360 import C360_CATEGORIES
    from driftwood.plans.q_preprocess import REGISTRY
    ref = customer360(spark, sf_dir, cutoff="2000-01-01")
    cur = customer360(spark, sf_dir, cutoff="2001-01-01")
    return rounded(D.pipeline_feature_drift(ref, cur, E.layout_from_registry(REGISTRY),
                                            categories=C360_CATEGORIES))


def _daily_summary(spark, sf_dir):
    """The events' summary as it is stored: written per day into the shared
    folder and read back."""
    events = table(spark, sf_dir, "events", ["ts", "event_type", "value"]).withColumn("day", F.to_date("ts"))
    path = _folder(spark, "summary")
    S.write_summary(S.summarise(events, ["value"], ["event_type"], by=["day"]), path, ["day"])
    return path


@query("summary_of_events", oracle="""WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, value FROM events),
v AS (SELECT day, 'value' AS feature, 'value' AS kind, value, NULL::VARCHAR AS category, count(*) AS n FROM d
      WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY day, value),
c AS (SELECT day, 'event_type', 'category', NULL::DOUBLE, event_type, count(*) FROM d WHERE event_type IS NOT NULL
      GROUP BY day, event_type)
SELECT CAST(day AS VARCHAR) AS day, feature, kind, value, category, n FROM (SELECT * FROM v UNION ALL SELECT * FROM c)""")
def summary_of_events(spark, sf_dir):
    stored = spark.read.parquet(_daily_summary(spark, sf_dir))
    return stored.select(F.col("day").cast("string").alias("day"), "feature", "kind", "value", "category", "n")


@query("drift_from_summaries", oracle=f"""WITH {event_halves_sql()},
{_ks_sql(False)},
{_chi_sql(4)},
all_rows AS (SELECT * FROM ks_rows UNION ALL SELECT * FROM chi_rows)
{_final('all_rows')}""")
def drift_from_summaries(spark, sf_dir):
    """The report of two spans of days from their stored summaries: the same
    as from the two halves of the table."""
    path = _daily_summary(spark, sf_dir)
    return rounded(S.report(S.read_summary(spark, path, f"day < '{SPLIT_TS}'"),
                            S.read_summary(spark, path, f"day >= '{SPLIT_TS}'")))
