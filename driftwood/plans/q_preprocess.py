"""Preprocessing queries (E1-E7, E10) on customer360."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwood.functions.features import add_features, required_features
from driftwood.operators import preprocess as E
from driftwood.plans.catalog import query
from driftwood.plans.common import rounded
from driftwood.plans.customer360 import C360_CATEGORIES, customer360, customer360_sql
from driftwood.plans.q_features import FEATURE_SQL

C360 = "WITH " + customer360_sql()
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
SCALED = ["Age", "Balance", "CreditScore", "EstimatedSalary"]


def _onehot_sql(col: str, values: list[str]) -> list[str]:
    return [f"CAST(CASE WHEN \"{col}\" = '{v}' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS \"cat__{col}_{v}\""
            for v in values]


@query("one_hot_card_gender", oracle=f"""{C360}
SELECT CustomerId, {", ".join(_onehot_sql("Card Type", SEGMENTS[1:]) + _onehot_sql("Gender", ["Male"]))}
FROM customer360""")
def one_hot_card_gender(spark, sf_dir):
    c = customer360(spark, sf_dir)
    p = E.fit(c, E.Layout(one_hot=("Card Type", "Gender")))
    return p.transform(c, keep=["CustomerId"])


def _scaled_sql(kind: str, source: str = "customer360", fit_where: str = "") -> str:
    where = f" WHERE {fit_where}" if fit_where else ""
    if kind == "standard":
        stats = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS a_{c}, "
                          f"coalesce(nullif(stddev_pop(CAST({c} AS DOUBLE)), 0), 1) AS b_{c}"
                          for c in SCALED)
    elif kind == "minmax":
        stats = ", ".join(f"min(CAST({c} AS DOUBLE)) AS a_{c}, "
                          f"coalesce(nullif(max(CAST({c} AS DOUBLE)) - min(CAST({c} AS DOUBLE)), 0), 1) AS b_{c}"
                          for c in SCALED)
    else:
        stats = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS a_{c}, "
                          f"coalesce(nullif(quantile_cont(CAST({c} AS DOUBLE), 0.75) - "
                          f"quantile_cont(CAST({c} AS DOUBLE), 0.25), 0), 1) AS b_{c}"
                          for c in SCALED)
    cols = ", ".join(f"round((CAST({c} AS DOUBLE) - a_{c}) / b_{c}, 6) AS num__{c}" for c in SCALED)
    return f"""{C360},
s AS (SELECT {stats} FROM {source}{where})
SELECT CustomerId, {cols} FROM {source}, s"""


def _scaled_query(spark, sf_dir, kind):
    c = customer360(spark, sf_dir)
    p = E.fit(c, E.Layout(scaled=tuple(SCALED)), scaler=kind)
    return rounded(p.transform(c, keep=["CustomerId"]))


@query("standard_scale", oracle=_scaled_sql("standard"))
def standard_scale(spark, sf_dir):
    return _scaled_query(spark, sf_dir, "standard")


@query("minmax_scale", oracle=_scaled_sql("minmax"))
def minmax_scale(spark, sf_dir):
    return _scaled_query(spark, sf_dir, "minmax")


@query("robust_scale", oracle=_scaled_sql("robust"))
def robust_scale(spark, sf_dir):
    return _scaled_query(spark, sf_dir, "robust")


@query("fit_retained_apply_all", oracle=_scaled_sql("standard", fit_where="Exited = 0"))
def fit_retained_apply_all(spark, sf_dir):
    c = customer360(spark, sf_dir)
    p = E.fit(c.where(F.col("Exited") == 0), E.Layout(scaled=tuple(SCALED)))
    return rounded(p.transform(c, keep=["CustomerId"]))


# The registry document that the results must match, without
# Satisfaction Score, which has no source in the binding.
REGISTRY = {
    "selected_features": ["Age_x_IsActive", "Balance_plus_Salary", "Balance_x_Tenure",
                          "Products_per_Tenure", "Num_Of_Products_1", "Num_Of_Products_2",
                          "is_germany"],
    "nomod_columns": ["HasCrCard"],
    "dummyfy_columns": ["Card Type", "Gender"],
    "norm_std_columns": ["Age", "Balance", "CreditScore"],
}


def _routed_sql() -> str:
    layout = E.layout_from_registry(REGISTRY)
    feats = required_features(layout.columns)
    fcols = ", ".join(f"{FEATURE_SQL[f]} AS {f}" for f in feats)
    stats = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS a_{c}, "
                      f"coalesce(nullif(stddev_pop(CAST({c} AS DOUBLE)), 0), 1) AS b_{c}"
                      for c in layout.scaled)
    cat = _onehot_sql("Card Type", SEGMENTS[1:]) + _onehot_sql("Gender", ["Male"])
    num = [f"round((CAST({c} AS DOUBLE) - a_{c}) / b_{c}, 6) AS num__{c}" for c in layout.scaled]
    pas = [f"CAST({c} AS DOUBLE) AS pass__{c}" for c in layout.passthrough]
    return f"""{C360},
f AS (SELECT *, {fcols} FROM customer360),
s AS (SELECT {stats} FROM f)
SELECT CustomerId, {", ".join(cat + num + pas)} FROM f, s"""


@query("routed_transform", oracle=_routed_sql())
def routed_transform(spark, sf_dir):
    layout = E.layout_from_registry(REGISTRY)
    need = required_features(layout.columns)
    f = add_features(customer360(spark, sf_dir), need, categories=C360_CATEGORIES)
    p = E.fit(f, layout)
    return rounded(p.transform(f, keep=["CustomerId"]))
