"""Profiling queries (A1-A15) on customer360 and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwood.functions.features import add_features
from driftwood.operators import profile as P
from driftwood.operators.selection import exact_quantiles
from driftwood.plans.catalog import query
from driftwood.plans.common import rounded
from driftwood.plans.customer360 import customer360, customer360_sql
from driftwood.sources.tables import table

C360 = "WITH " + customer360_sql()

PROFILE_COLUMNS = [("CustomerId", "bigint"), ("Surname", "string"), ("CreditScore", "int"),
                   ("Geography", "string"), ("Gender", "string"), ("Age", "int"),
                   ("Tenure", "int"), ("Balance", "double"), ("NumOfProducts", "int"),
                   ("HasCrCard", "int"), ("IsActiveMember", "int"),
                   ("EstimatedSalary", "double"), ("Card Type", "string"), ("Exited", "int")]


def _profile_sql() -> str:
    parts = []
    for c, t in PROFILE_COLUMNS:
        q = f'"{c}"'
        parts.append(
            f"SELECT '{c}' AS column_name, '{t}' AS dtype, count({q}) AS non_null, "
            f"count(*) - count({q}) AS missing, "
            f"round((count(*) - count({q})) * 100.0 / count(*), 6) AS pct_missing, "
            f"count(DISTINCT {q}) AS n_distinct FROM customer360")
    return C360 + "\n" + "\nUNION ALL\n".join(parts)


@query("column_profile", oracle=_profile_sql())
def column_profile(spark, sf_dir):
    p = P.column_profile(customer360(spark, sf_dir))
    return rounded(p.withColumnsRenamed({"column": "column_name", "distinct": "n_distinct"}))


@query("value_counts_geography", oracle=f"""{C360}
SELECT Geography, count(*) AS count,
       round(count(*) / (SELECT count(Geography) FROM customer360), 6) AS proportion
FROM customer360 WHERE Geography IS NOT NULL GROUP BY Geography""")
def value_counts_geography(spark, sf_dir):
    return rounded(P.value_counts(customer360(spark, sf_dir), "Geography"))


@query("churn_rate_by_geography", oracle=f"""{C360}
SELECT Geography, round(avg(Exited), 6) AS rate, count(*) AS n
FROM customer360 GROUP BY Geography""")
def churn_rate_by_geography(spark, sf_dir):
    return rounded(P.rate_by_category(customer360(spark, sf_dir), "Geography", "Exited"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("crosstab_exited_card_type", oracle=f"""{C360}
SELECT Exited, {", ".join(f"count(*) FILTER (WHERE \"Card Type\" = '{s}') AS {s}" for s in SEGMENTS)}
FROM customer360 WHERE Exited IS NOT NULL AND "Card Type" IS NOT NULL GROUP BY Exited""")
def crosstab_exited_card_type(spark, sf_dir):
    return P.crosstab(customer360(spark, sf_dir), "Exited", "Card Type")


@query("histogram_balance", oracle=f"""{C360},
b AS (SELECT Balance AS v FROM customer360 WHERE Balance IS NOT NULL AND NOT isnan(Balance)),
s AS (SELECT min(v) AS mn, max(v) AS mx, count(*) AS n FROM b),
w AS (SELECT mn, n, CASE WHEN mx > mn THEN (mx - mn) / 30 ELSE 1.0 END AS width FROM s),
c AS (SELECT CAST(least(floor((v - mn) / width), 29) AS INTEGER) AS bin, count(*) AS cnt
      FROM b, w GROUP BY 1),
g AS (SELECT CAST(range AS INTEGER) AS bin FROM range(30))
SELECT g.bin, round(w.mn + g.bin * w.width, 6) AS lo, round(w.mn + (g.bin + 1) * w.width, 6) AS hi,
       coalesce(c.cnt, 0) AS count, round(coalesce(c.cnt, 0) / (w.n * w.width), 6) AS density
FROM g CROSS JOIN w LEFT JOIN c ON g.bin = c.bin""")
def histogram_balance(spark, sf_dir):
    return rounded(P.histogram(customer360(spark, sf_dir), "Balance", bins=30))


def _box_sql(source: str, by: list[str], value: str) -> str:
    keys = ", ".join(by)
    on = " AND ".join(f"b.{k} = q.{k}" for k in by)
    return f"""b AS (SELECT {keys}, CAST({value} AS DOUBLE) AS v FROM {source}
       WHERE {value} IS NOT NULL AND NOT isnan(CAST({value} AS DOUBLE))),
q AS (SELECT {keys}, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
             quantile_cont(v, 0.75) AS q3 FROM b GROUP BY {keys})
SELECT {", ".join(f"q.{k}" for k in by)}, round(q.q1, 6) AS q1, round(q.median, 6) AS median,
       round(q.q3, 6) AS q3,
       round(min(v) FILTER (WHERE v >= q.q1 - 1.5 * (q.q3 - q.q1)), 6) AS whisker_low,
       round(max(v) FILTER (WHERE v <= q.q3 + 1.5 * (q.q3 - q.q1)), 6) AS whisker_high,
       count(*) FILTER (WHERE v < q.q1 - 1.5 * (q.q3 - q.q1) OR v > q.q3 + 1.5 * (q.q3 - q.q1)) AS outliers,
       count(*) AS n
FROM b JOIN q ON {on}
GROUP BY {", ".join(f"q.{k}" for k in by)}, q.q1, q.median, q.q3"""


@query("box_stats_salary_by_geography",
       oracle=f"{C360},\n" + _box_sql("customer360", ["Geography"], "EstimatedSalary"))
def box_stats_salary_by_geography(spark, sf_dir):
    return rounded(P.box_stats(customer360(spark, sf_dir), "EstimatedSalary", by=["Geography"]))


@query("distribution_matrix", oracle=f"""{C360},
long AS (
  SELECT cat_col, category, cont_col, value FROM (
    SELECT 'Geography' AS cat_col, Geography AS category, Balance, EstimatedSalary FROM customer360
    UNION ALL
    SELECT 'Gender', Gender, Balance, EstimatedSalary FROM customer360)
  UNPIVOT INCLUDE NULLS (value FOR cont_col IN (Balance, EstimatedSalary))),
""" + _box_sql("long", ["cat_col", "category", "cont_col"], "value"))
def distribution_matrix(spark, sf_dir):
    return rounded(P.category_distribution_matrix(
        customer360(spark, sf_dir), ["Geography", "Gender"], ["Balance", "EstimatedSalary"]))


CORR_COLUMNS = ["Age", "Balance", "EstimatedSalary", "Tenure", "CreditScore"]


def _corr_pairs():
    return [(a, b) for i, a in enumerate(CORR_COLUMNS) for j, b in enumerate(CORR_COLUMNS) if i > j]


@query("correlation_pearson", oracle=f"""{C360}
""" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM customer360"
    for a, b in _corr_pairs()))
def correlation_pearson(spark, sf_dir):
    return rounded(P.correlation_matrix(customer360(spark, sf_dir), CORR_COLUMNS, "pearson"))


def _spearman_sql(a: str, b: str) -> str:
    def ranked(c):
        return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    return f"""SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(x, y), 6) AS corr
FROM (SELECT {ranked('a')} AS x, {ranked('b')} AS y
      FROM (SELECT CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b FROM customer360
            WHERE {a} IS NOT NULL AND {b} IS NOT NULL))"""


@query("correlation_spearman", oracle=C360 + "\n" + "\nUNION ALL\n".join(
    _spearman_sql(a, b) for a, b in _corr_pairs()))
def correlation_spearman(spark, sf_dir):
    return rounded(P.correlation_matrix(customer360(spark, sf_dir), CORR_COLUMNS, "spearman"))


def _kendall_sql(source: str, a: str, b: str) -> str:
    """tau-b by pairs of cells: for tables of few distinct cells."""
    return f"""SELECT '{a}' AS col_a, '{b}' AS col_b, (
  WITH c AS (SELECT {a}::DOUBLE AS x, {b}::DOUBLE AS y, count(*)::HUGEINT AS n FROM {source}
             WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL),
  s AS (SELECT sum(p.n * q.n * sign(p.y - q.y)) AS s FROM c p JOIN c q ON p.x > q.x),
  t AS (SELECT sum(n) * (sum(n) - 1) / 2 AS n0 FROM c),
  tx AS (SELECT sum(n * (n - 1)) / 2 AS n1 FROM (SELECT sum(n) AS n FROM c GROUP BY x)),
  ty AS (SELECT sum(n * (n - 1)) / 2 AS n2 FROM (SELECT sum(n) AS n FROM c GROUP BY y))
  SELECT round(s / sqrt((n0 - n1)::DOUBLE * (n0 - n2)), 6) FROM s, t, tx, ty) AS corr"""


@query("correlation_kendall", oracle=C360 + "\n" + "\nUNION ALL\n".join(
    _kendall_sql("customer360", a, b) for a, b in _corr_pairs()))
def correlation_kendall(spark, sf_dir):
    return rounded(P.correlation_matrix(customer360(spark, sf_dir), CORR_COLUMNS, "kendall"))


@query("li_kendall", oracle=_kendall_sql("lineitem", "l_discount", "l_quantity") + "\nUNION ALL\n"
       + _kendall_sql("lineitem", "l_tax", "l_discount"))
def li_kendall(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", ["l_quantity", "l_discount", "l_tax"])
    from driftwood.operators.kendall import kendall
    return rounded(kendall(li, [("l_discount", "l_quantity"), ("l_tax", "l_discount")]))


KDE_POINTS = 64


@query("kde_age_by_exited", oracle=f"""{C360},
base AS (SELECT CAST(Exited AS VARCHAR) AS grp, CAST(Age AS DOUBLE) AS v FROM customer360
         WHERE Exited IS NOT NULL AND Age IS NOT NULL),
mm AS (SELECT min(v) AS mn, (max(v) - min(v)) / {KDE_POINTS - 1} AS step FROM base),
st AS (SELECT grp, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS h FROM base GROUP BY grp),
dv AS (SELECT grp, v, count(*) AS w FROM base GROUP BY grp, v),
g AS (SELECT CAST(range AS INTEGER) AS i FROM range({KDE_POINTS}))
SELECT dv.grp AS "group", g.i AS point, round(mm.mn + g.i * mm.step, 6) AS x,
       round(sum(dv.w * exp(-0.5 * pow((mm.mn + g.i * mm.step - dv.v) / st.h, 2)))
             / (any_value(st.n) * any_value(st.h) * sqrt(2 * pi())), 6) AS density
FROM dv JOIN st ON dv.grp = st.grp CROSS JOIN g CROSS JOIN mm
GROUP BY dv.grp, g.i, mm.mn, mm.step""")
def kde_age_by_exited(spark, sf_dir):
    return rounded(P.gaussian_kde(customer360(spark, sf_dir), "Age",
                                  grid_points=KDE_POINTS, by="Exited")
                   .select("group", "point", "x", "density"))


@query("kde_binned_price", oracle=f"""WITH base AS (
  SELECT l_linestatus AS grp, CAST(l_extendedprice AS DOUBLE) / 1000 AS v FROM lineitem
  WHERE l_linestatus IS NOT NULL AND l_extendedprice IS NOT NULL),
mm AS (SELECT min(v) AS mn, (max(v) - min(v)) / {KDE_POINTS - 1} AS step FROM base),
st AS (SELECT grp, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS h FROM base GROUP BY grp),
dv AS (SELECT grp, v, count(*) AS w FROM base GROUP BY grp, v),
g AS (SELECT CAST(range AS INTEGER) AS i FROM range({KDE_POINTS}))
SELECT dv.grp AS "group", g.i AS point,
       round(sum(dv.w * exp(-0.5 * pow((mm.mn + g.i * mm.step - dv.v) / st.h, 2)))
             / (any_value(st.n) * any_value(st.h) * sqrt(2 * pi())), 4) AS density
FROM dv JOIN st ON dv.grp = st.grp CROSS JOIN g CROSS JOIN mm
GROUP BY dv.grp, g.i""")
def kde_binned_price(spark, sf_dir):
    """Near-unique values: shared out to a fine grid, within 1e-8 of the exact
    sum (in units of one by bandwidth), which the twin takes."""
    li = table(spark, sf_dir, "lineitem", ["l_linestatus", "l_extendedprice"]) \
        .select("l_linestatus", (F.col("l_extendedprice").cast("double") / 1000).alias("v"))
    kde = P.gaussian_kde(li, "v", grid_points=KDE_POINTS, by="l_linestatus", tolerance=1e-8)
    return rounded(kde.select("group", "point", "density"), 4)


@query("positive_rate_change", oracle=f"""WITH {customer360_sql("2000-01-01", "ref")},
{customer360_sql("2001-01-01", "cur")},
r AS (SELECT avg(Exited) AS a FROM ref), c AS (SELECT avg(Exited) AS b FROM cur)
SELECT round(a, 6) AS reference_positive_rate, round(b, 6) AS current_positive_rate,
       round(b - a, 6) AS absolute_change, round((b - a) / a * 100.0, 6) AS relative_change_pct
FROM r, c""")
def positive_rate_change(spark, sf_dir):
    ref = customer360(spark, sf_dir, cutoff="2000-01-01")
    cur = customer360(spark, sf_dir, cutoff="2001-01-01")
    return rounded(P.class_rate_change(ref, cur, "Exited"))


@query("argmax_wealth", oracle=f"""{C360}
SELECT CustomerId, round({'0.6 * Balance + 0.4 * EstimatedSalary'}, 6) AS WealthScore
FROM customer360
ORDER BY 0.6 * Balance + 0.4 * EstimatedSalary DESC NULLS LAST, CustomerId LIMIT 1""")
def argmax_wealth(spark, sf_dir):
    f = add_features(customer360(spark, sf_dir), ["WealthScore"])
    return rounded(P.argmax_row(f.select("CustomerId", "WealthScore"), "WealthScore", "CustomerId"))


QPROBS = [0.1, 0.25, 0.5, 0.75, 0.9]


@query("quantiles_extendedprice", oracle=f"""SELECT l_returnflag,
  {", ".join(f"round(quantile_cont(l_extendedprice, {p}), 6) AS q_{i}" for i, p in enumerate(QPROBS))}
FROM lineitem WHERE l_extendedprice IS NOT NULL AND NOT isnan(l_extendedprice)
  AND l_returnflag IS NOT NULL
GROUP BY l_returnflag""")
def quantiles_extendedprice(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", ["l_returnflag", "l_extendedprice"])
    return rounded(exact_quantiles(li, "l_extendedprice", QPROBS, by=["l_returnflag"]))


@query("box_stats_lineitem_quantity", oracle="""WITH
""" + _box_sql("lineitem", ["l_linestatus"], "l_quantity"))
def box_stats_lineitem_quantity(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", ["l_linestatus", "l_quantity"])
    return rounded(P.box_stats(li, "l_quantity", by=["l_linestatus"]))
