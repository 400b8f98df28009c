"""Experiment-run and search-trial tables derived from ``orders``.

Every order becomes one run: its priority is the experiment, its status the
run status, arithmetic on its keys and price gives metrics and parameters.
The same derivation exists as DuckDB SQL (flat columns) for the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.sources.tables import table

MODELS = ["LogisticRegression", "DecisionTree", "RandomForest", "BoostedTrees"]

# metric name -> (multiplier on o_orderkey, multiplier on o_custkey); the
# value is ((k * a + c * b) mod 1000) / 1000
METRIC_RULES = {
    "best_optuna_val_pr_auc": (1, 13),
    "accuracy": (7, 1),
    "precision": (11, 3),
    "recall": (17, 5),
    "f1_score": (19, 7),
    "roc_auc": (23, 11),
    "pr_auc": (29, 17),
}


def _metric(a: int, b: int) -> Column:
    return F.pmod(F.col("o_orderkey") * a + F.col("o_custkey") * b, F.lit(1000)) / 1000.0


def _test_pr_auc() -> Column:
    return F.when(F.pmod(F.col("o_orderkey"), F.lit(7)) == 0, F.lit(None).cast("double")) \
        .otherwise(F.pmod(F.round(F.col("o_totalprice")).cast("long"), F.lit(1000)) / 1000.0)


def _pr_auc_cv() -> Column:
    return F.when(F.pmod(F.col("o_orderkey"), F.lit(3)) == 0, F.lit(None).cast("double")) \
        .otherwise(F.pmod(F.col("o_orderkey") * 31 + F.col("o_custkey"), F.lit(1000)) / 1000.0)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders",
              ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "o_orderpriority"])
    run_name = F.element_at(F.array(*[F.lit(m) for m in MODELS]),
                            (F.pmod(F.col("o_custkey"), F.lit(4)) + 1).cast("int"))
    parent = F.when(F.pmod(F.col("o_orderkey"), F.lit(2)) == 0, F.lit(None).cast("string")) \
        .otherwise(F.concat(F.lit("run-"), (F.col("o_orderkey") - 1).cast("string")))
    metrics = F.create_map(
        F.lit("test_pr_auc"), _test_pr_auc(), F.lit("pr_auc_cv"), _pr_auc_cv(),
        *[x for name, (a, b) in METRIC_RULES.items() for x in (F.lit(name), _metric(a, b))])
    params = F.create_map(
        F.lit("max_depth"), (F.lit(3) + F.pmod(F.col("o_orderkey"), F.lit(8))).cast("string"),
        F.lit("learning_rate"), (F.lit(0.01) + F.pmod(F.col("o_custkey"), F.lit(100)) / 1000.0)
        .cast("string"))
    tags = F.create_map(F.lit("mlflow.runName"), run_name, F.lit("mlflow.parentRunId"), parent)
    start = (F.col("o_orderdate") + F.make_dt_interval(
        secs=F.pmod(F.col("o_orderkey"), F.lit(86400)).cast("decimal(10,0)")))
    return o.select(
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"),
        F.substring("o_orderpriority", 1, 1).alias("experiment_id"),
        F.col("o_orderpriority").alias("experiment"),
        F.when(F.col("o_orderstatus") == "F", "FINISHED")
        .when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("FAILED").alias("status"),
        start.alias("start_time"),
        metrics.alias("metrics"), params.alias("params"), tags.alias("tags"))


def runs_sql(name: str = "runs") -> str:
    """Flat DuckDB twin: metrics as m_<name> columns, tags as columns."""
    models = ", ".join(f"'{m}'" for m in MODELS)
    metric_cols = ",\n         ".join(
        f"((o_orderkey * {a} + o_custkey * {b}) % 1000) / 1000.0 AS m_{n}"
        for n, (a, b) in METRIC_RULES.items())
    return f"""{name} AS (
  SELECT 'run-' || CAST(o_orderkey AS VARCHAR) AS run_id,
         substring(o_orderpriority, 1, 1) AS experiment_id,
         o_orderpriority AS experiment,
         CASE o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status,
         o_orderdate + to_seconds(o_orderkey % 86400) AS start_time,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL
              ELSE (CAST(round(o_totalprice) AS BIGINT) % 1000) / 1000.0 END AS m_test_pr_auc,
         CASE WHEN o_orderkey % 3 = 0 THEN NULL
              ELSE ((o_orderkey * 31 + o_custkey) % 1000) / 1000.0 END AS m_pr_auc_cv,
         {metric_cols},
         [{models}][o_custkey % 4 + 1] AS run_name,
         CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'run-' || CAST(o_orderkey - 1 AS VARCHAR) END AS parent_run_id
  FROM orders)"""


# --- search trials ---------------------------------------------------------

TRIAL_PARAMS = {
    # parameter -> (SQL-neutral arithmetic on o_orderkey / o_custkey)
    "learning_rate": "0.01 + (o_custkey % 100) / 1000.0",
    "max_depth": "3 + o_orderkey % 8",
    "subsample": "0.5 + (o_orderkey % 50) / 100.0",
    "n_estimators": "100 + (o_custkey * 7) % 900",
    "gamma": "0.0 * o_orderkey",
}


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"])
    params = F.create_map(*[x for n, e in TRIAL_PARAMS.items()
                            for x in (F.lit(n), F.expr(e).cast("double"))])
    value = F.pmod(F.col("o_orderkey") * 37 + F.round(F.col("o_totalprice")).cast("long"),
                   F.lit(1000)) / 1000.0
    return o.select(
        F.col("o_orderkey").alias("number"),
        F.when(F.col("o_orderstatus") == "P", "PRUNED").otherwise("COMPLETE").alias("state"),
        value.alias("value"), params.alias("params"))


def trials_sql(name: str = "trials") -> str:
    cols = ",\n         ".join(f"CAST({e} AS DOUBLE) AS p_{n}" for n, e in TRIAL_PARAMS.items())
    return f"""{name} AS (
  SELECT o_orderkey AS number,
         CASE WHEN o_orderstatus = 'P' THEN 'PRUNED' ELSE 'COMPLETE' END AS state,
         ((o_orderkey * 37 + CAST(round(o_totalprice) AS BIGINT)) % 1000) / 1000.0 AS value,
         {cols}
  FROM orders)"""
