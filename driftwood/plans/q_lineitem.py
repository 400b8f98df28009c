"""Operator queries on lineitem (the largest table): the same operators as
the churn-shaped queries, at 600k rows per 0.1 scale factor.  These are
the bench's headline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwood.functions.features import add_features
from driftwood.functions.stats import chi2_sf_dof1_sql, chi2_sf_even_sql, ks_sf_sql
from driftwood.operators import drift as D
from driftwood.operators import metrics as M
from driftwood.operators import preprocess as E
from driftwood.operators import profile as P
from driftwood.operators import splits as K
from driftwood.plans.catalog import query
from driftwood.plans.common import rounded
from driftwood.sources.tables import table

LI_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_CATEGORICAL = ["l_returnflag", "l_linestatus"]
SHIP_CUT = "1996-06-01"


def _li(spark, sf_dir, cols=None):
    return table(spark, sf_dir, "lineitem", cols)


# churn columns mapped onto lineitem for the feature bench
LI_CHURN = {"Balance": "l_extendedprice", "Age": "l_quantity", "Tenure": "l_linenumber",
            "EstimatedSalary": "net_price", "NumOfProducts": "n_products",
            "IsActiveMember": "open_line", "CreditScore": "l_linenumber"}
LI_FEATURES = ["no_balance", "middle_age", "Num_Of_Products_2", "Balance_to_Salary",
               "Balance_per_Product", "Inactive_x_Balance", "WealthScore", "LogBalance",
               "Age2", "Balance_per_Tenure"]


@query("li_feature_means", oracle=f"""WITH b AS (
  SELECT l_returnflag, l_extendedprice AS bal, CAST(l_quantity AS DOUBLE) AS age,
         CAST(l_linenumber AS DOUBLE) AS ten, l_extendedprice * (1 - l_discount) AS sal,
         CAST(1 + l_linenumber % 4 AS DOUBLE) AS prod,
         CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS DOUBLE) AS act FROM lineitem)
SELECT l_returnflag, count(*) AS n,
       count(*) FILTER (WHERE coalesce(bal < 2500, false)) AS no_balance,
       count(*) FILTER (WHERE coalesce(age > 25 AND age < 45, false)) AS middle_age,
       count(*) FILTER (WHERE coalesce(prod = 2, false)) AS Num_Of_Products_2,
       round(avg(bal / (sal + 1)), 6) AS Balance_to_Salary,
       round(avg(bal / (prod + 1)), 6) AS Balance_per_Product,
       round(avg((1 - act) * bal), 6) AS Inactive_x_Balance,
       round(avg(0.6 * bal + 0.4 * sal), 6) AS WealthScore,
       round(avg(CASE WHEN bal > -1 THEN ln(1 + bal) END), 6) AS LogBalance,
       round(avg(age * age), 6) AS Age2,
       round(avg(bal / (ten + 1)), 6) AS Balance_per_Tenure
FROM b GROUP BY l_returnflag""")
def li_feature_means(spark, sf_dir):
    li = _li(spark, sf_dir, ["l_returnflag", "l_extendedprice", "l_quantity", "l_linenumber",
                             "l_discount", "l_linestatus"])
    base = li.select("l_returnflag", "l_extendedprice", "l_quantity", "l_linenumber",
                     (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_price"),
                     (F.lit(1) + F.pmod("l_linenumber", F.lit(4))).alias("n_products"),
                     (F.col("l_linestatus") == "O").cast("int").alias("open_line"))
    f = add_features(base, LI_FEATURES, columns=LI_CHURN)
    binary = LI_FEATURES[:3]
    return rounded(f.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(b)).alias(b) for b in binary],
        *[F.avg(c).alias(c) for c in LI_FEATURES[3:]]))


@query("li_column_profile", oracle="\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, count({c}) AS non_null, "
    f"count(*) - count({c}) AS missing, "
    f"round((count(*) - count({c})) * 100.0 / count(*), 6) AS pct_missing, "
    f"count(DISTINCT {c}) AS n_distinct FROM lineitem"
    for c, t in [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"),
                 ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
                 ("l_returnflag", "string"), ("l_linestatus", "string"),
                 ("l_shipdate", "timestamp_ntz")]))
def li_column_profile(spark, sf_dir):
    p = P.column_profile(_li(spark, sf_dir))
    return rounded(p.withColumnsRenamed({"column": "column_name", "distinct": "n_distinct"}))


@query("li_histogram_price", oracle="""WITH
b AS (SELECT l_extendedprice AS v FROM lineitem WHERE l_extendedprice IS NOT NULL AND NOT isnan(l_extendedprice)),
s AS (SELECT min(v) AS mn, max(v) AS mx, count(*) AS n FROM b),
w AS (SELECT mn, n, CASE WHEN mx > mn THEN (mx - mn) / 30 ELSE 1.0 END AS width FROM s),
c AS (SELECT CAST(least(floor((v - mn) / width), 29) AS INTEGER) AS bin, count(*) AS cnt FROM b, w GROUP BY 1),
g AS (SELECT CAST(range AS INTEGER) AS bin FROM range(30))
SELECT g.bin, round(w.mn + g.bin * w.width, 6) AS lo, round(w.mn + (g.bin + 1) * w.width, 6) AS hi,
       coalesce(c.cnt, 0) AS count, round(coalesce(c.cnt, 0) / (w.n * w.width), 6) AS density
FROM g CROSS JOIN w LEFT JOIN c ON g.bin = c.bin""")
def li_histogram_price(spark, sf_dir):
    return rounded(P.histogram(_li(spark, sf_dir, ["l_extendedprice"]), "l_extendedprice", 30))


@query("li_correlation", oracle="\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM lineitem"
    for i, a in enumerate(LI_NUMERIC) for j, b in enumerate(LI_NUMERIC) if i > j))
def li_correlation(spark, sf_dir):
    return rounded(P.correlation_matrix(_li(spark, sf_dir, LI_NUMERIC), LI_NUMERIC))


@query("li_stratified_split", oracle="""WITH
cls AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag),
t AS (SELECT l_returnflag, n, CAST(floor(n * CAST(0.2 AS DOUBLE) + 0.5) AS BIGINT) AS n_test FROM cls)
SELECT 'test' AS split, l_returnflag, n_test AS n FROM t
UNION ALL SELECT 'train', l_returnflag, n - n_test FROM t""")
def li_stratified_split(spark, sf_dir):
    li = _li(spark, sf_dir, ["l_orderkey", "l_linenumber", "l_returnflag"]) \
        .withColumn("line_key", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    s = K.stratified_split(li, "l_returnflag", "line_key", test_size=0.2, seed=43)
    return s.groupBy("split", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("li_routed_transform_sums", oracle=f"""WITH
s AS (SELECT {", ".join(f"avg({c}) AS a_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS b_{c}" for c in LI_NUMERIC)}
      FROM lineitem),
t AS (SELECT l_returnflag AS grp,
             CAST(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS "cat__l_returnflag_N",
             CAST(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS "cat__l_returnflag_R",
             CAST(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS "cat__l_linestatus_O",
             {", ".join(f"({c} - a_{c}) / b_{c} AS num__{c}" for c in LI_NUMERIC)},
             CAST(l_linenumber AS DOUBLE) AS pass__l_linenumber
      FROM lineitem, s)
SELECT grp, count(*) AS n, {", ".join(f'round(sum("{c}"), 6) AS "{c}"' for c in
    ["cat__l_returnflag_N", "cat__l_returnflag_R", "cat__l_linestatus_O"] +
    [f"num__{c}" for c in LI_NUMERIC] + ["pass__l_linenumber"])}
FROM t GROUP BY grp""")
def li_routed_transform_sums(spark, sf_dir):
    li = _li(spark, sf_dir, LI_NUMERIC + LI_CATEGORICAL + ["l_linenumber"])
    layout = E.Layout(one_hot=tuple(LI_CATEGORICAL), scaled=tuple(LI_NUMERIC),
                      passthrough=("l_linenumber",))
    p = E.fit(li, layout)
    t = p.transform(li.withColumn("grp", F.col("l_returnflag")), keep=["grp"])
    return rounded(t.groupBy("grp").agg(F.count(F.lit(1)).alias("n"),
                                        *[F.sum(F.col(f"`{c}`")).alias(c) for c in p.output_names()]))


def _li_scored(spark, sf_dir):
    li = _li(spark, sf_dir, ["l_returnflag", "l_extendedprice", "l_discount"])
    return li.select((F.col("l_returnflag") == "R").cast("int").alias("label"),
                     (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 100000.0).alias("score"))


@query("li_ranking_metrics", oracle="""WITH
sc AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS label,
              l_extendedprice * (1 - l_discount) / 100000.0 AS score FROM lineitem),
pv AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
       FROM sc WHERE score IS NOT NULL GROUP BY score),
cum AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp,
               sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM pv)
SELECT round(sum(neg * (tp - pos + 0.5 * pos)) / (any_value(P) * any_value(N)), 6) AS roc_auc,
       round(sum(pos * tp / (tp + fp)) / any_value(P), 6) AS pr_auc FROM cum""")
def li_ranking_metrics(spark, sf_dir):
    return rounded(M.ranking_metrics(_li_scored(spark, sf_dir), "label", "score"))


def _li_halves(spark, sf_dir):
    li = _li(spark, sf_dir, LI_NUMERIC + LI_CATEGORICAL + ["l_shipdate"])
    cut = F.lit(SHIP_CUT).cast("timestamp_ntz")
    return (li.where(F.col("l_shipdate") < cut).drop("l_shipdate"),
            li.where(F.col("l_shipdate") >= cut).drop("l_shipdate"))


def _li_ks_sql() -> str:
    parts = []
    for c in LI_NUMERIC:
        parts.append(f"""SELECT '{c}' AS feature, {c} AS value, side FROM u WHERE {c} IS NOT NULL""")
    return f"""u AS (SELECT *, CASE WHEN l_shipdate < TIMESTAMP '{SHIP_CUT}' THEN 0 ELSE 1 END AS side
      FROM lineitem WHERE l_shipdate IS NOT NULL),
lg AS ({" UNION ALL ".join(parts)}),
pv AS (SELECT feature, value, count(*) FILTER (WHERE side = 0) AS n0, count(*) FILTER (WHERE side = 1) AS n1
       FROM lg GROUP BY feature, value),
c AS (SELECT feature, sum(n0) OVER (PARTITION BY feature ORDER BY value) AS c0,
             sum(n1) OVER (PARTITION BY feature ORDER BY value) AS c1,
             sum(n0) OVER (PARTITION BY feature) AS t0, sum(n1) OVER (PARTITION BY feature) AS t1 FROM pv),
ks AS (SELECT feature, max(abs(c0 / t0 - c1 / t1)) AS d, CAST(any_value(t0) AS DOUBLE) AS n_ref,
              CAST(any_value(t1) AS DOUBLE) AS n_cur FROM c GROUP BY feature)"""


@query("li_ks_report", oracle=f"""WITH {_li_ks_sql()}
SELECT feature, 'numerical' AS type, 'KS-Statistic' AS metric_name, round(d, 6) AS metric_value,
       round({ks_sf_sql('d', 'n_ref', 'n_cur')}, 6) AS p_value,
       {ks_sf_sql('d', 'n_ref', 'n_cur')} < 0.05 AS drift_detected FROM ks""")
def li_ks_report(spark, sf_dir):
    ref, cur = _li_halves(spark, sf_dir)
    return rounded(D.ks_test(ref, cur, LI_NUMERIC))


def _li_chi_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c} AS category, side FROM u WHERE {c} IS NOT NULL"
        for c in LI_CATEGORICAL)
    return f"""cl AS ({parts}),
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
              sum(CASE WHEN k = 2 THEN pow(d_ref - least(0.5, d_ref), 2) / e_ref
                                       + pow(d_cur - least(0.5, d_cur), 2) / e_cur
                       ELSE pow(d_ref, 2) / e_ref + pow(d_cur, 2) / e_cur END) AS stat
       FROM ex GROUP BY feature),
chp AS (SELECT feature, stat, CASE WHEN k = 2 THEN {chi2_sf_dof1_sql('stat')}
                                    WHEN k = 3 THEN {chi2_sf_even_sql('stat', 2)} END AS p FROM ch)"""


@query("li_drift_report", oracle=f"""WITH {_li_ks_sql()},
{_li_chi_sql()}
SELECT feature, 'numerical' AS type, 'KS-Statistic' AS metric_name, round(d, 6) AS metric_value,
       round({ks_sf_sql('d', 'n_ref', 'n_cur')}, 6) AS p_value,
       {ks_sf_sql('d', 'n_ref', 'n_cur')} < 0.05 AS drift_detected FROM ks
UNION ALL
SELECT feature, 'categorical', 'Chi2-Statistic', round(stat, 6), round(p, 6), p < 0.05 FROM chp""")
def li_drift_report(spark, sf_dir):
    """KS on four numeric and chi-square on two categorical columns."""
    ref, cur = _li_halves(spark, sf_dir)
    return rounded(D.feature_drift_report(ref, cur, LI_NUMERIC, LI_CATEGORICAL))


@query("li_quantiles", oracle="""SELECT l_linestatus,
  round(quantile_cont(l_quantity, 0.25), 6) AS q_0, round(quantile_cont(l_quantity, 0.5), 6) AS q_1,
  round(quantile_cont(l_quantity, 0.75), 6) AS q_2, round(quantile_cont(l_extendedprice, 0.5), 6) AS m_price
FROM lineitem WHERE l_linestatus IS NOT NULL GROUP BY l_linestatus""")
def li_quantiles(spark, sf_dir):
    from driftwood.operators.selection import exact_quantiles
    li = _li(spark, sf_dir, ["l_linestatus", "l_quantity", "l_extendedprice"])
    q = exact_quantiles(li, "l_quantity", [0.25, 0.5, 0.75], by=["l_linestatus"])
    m = exact_quantiles(li, "l_extendedprice", [0.5], by=["l_linestatus"]) \
        .withColumnRenamed("q_0", "m_price")
    return rounded(q.join(m, "l_linestatus"))
