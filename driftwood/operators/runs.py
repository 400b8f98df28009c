"""Queries over a table of experiment runs (the tracking store re-aimed as a
DataFrame): run_id, experiment_id, experiment, status, start_time,
metrics map<string,double>, params map<string,string>, tags
map<string,string> (``mlflow.runName``, ``mlflow.parentRunId``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from driftwood.operators.cumulative import running_totals
from driftwood.operators.topk import top1_per_group

RUN_NAME = "mlflow.runName"
PARENT = "mlflow.parentRunId"
ISO = "yyyy-MM-dd'T'HH:mm:ss"


def metric(name: str) -> Column:
    return F.try_element_at(F.col("metrics"), F.lit(name))


def tag(name: str) -> Column:
    return F.try_element_at(F.col("tags"), F.lit(name))


def iso_date(start: Column, kind) -> Column:
    """ISO text of a timestamp or of milliseconds since the epoch."""
    if isinstance(kind, IntegralType):
        start = F.timestamp_millis(start.cast("long"))
    return F.date_format(start, ISO)


def finished_parents(runs: DataFrame) -> DataFrame:
    return runs.where(tag(PARENT).isNull() & (F.col("status") == "FINISHED"))


def best_runs_per_experiment(runs: DataFrame, primary: str = "test_pr_auc",
                             fallback: str = "best_optuna_val_pr_auc") -> DataFrame:
    """Best finished parent run of every experiment by (primary desc,
    fallback desc, nulls last; run_id breaks ties); its score is primary,
    else fallback (NaN counts as missing); experiments whose best run has
    no score are dropped."""
    start_type = runs.schema["start_time"].dataType
    cand = finished_parents(runs).select(
        "experiment", "experiment_id", "run_id", "start_time",
        tag(RUN_NAME).alias("run_name"),
        metric(primary).alias("_p"), metric(fallback).alias("_f"))
    best = top1_per_group(cand, ["experiment"], [("_p", "desc"), ("_f", "desc"), ("run_id", "asc")])
    known = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double"))
    score = F.coalesce(known("_p"), known("_f"))
    return best.where(score.isNotNull()).select(
        "experiment", "experiment_id", "run_id",
        F.coalesce("run_name", F.lit("Unnamed Model")).alias("run_name"),
        score.alias(primary),
        iso_date(F.col("start_time"), start_type).alias("date"))


SUMMARY_METRICS = ["accuracy", "precision", "recall", "f1_score"]
OPTIONAL_METRICS = ["roc_auc", "pr_auc_cv"]


def experiment_summary(runs: DataFrame, experiment: str,
                       sort_metric: str | None = "pr_auc_cv") -> DataFrame:
    """Runs of one experiment with the standard metrics (missing ones are
    null), sorted by ``sort_metric`` desc when given."""
    out = runs.where(F.col("experiment") == experiment).select(
        "run_id", tag(RUN_NAME).alias("run_name"),
        *[metric(m).alias(m) for m in SUMMARY_METRICS + OPTIONAL_METRICS], "start_time")
    if sort_metric:
        out = out.orderBy(F.desc_nulls_last(sort_metric), "run_id")
    return out


def best_run(runs: DataFrame, experiment: str, order_metric: str | list[str] = "pr_auc",
             run_name: str | None = None, params: dict | None = None) -> DataFrame:
    """Top run of an experiment by one or more metrics desc, each nulls last
    (later ones break ties, then run_id); optionally only runs with a given
    name or with given parameter values.  One row is kept per task."""
    keys = [order_metric] if isinstance(order_metric, str) else list(order_metric)
    sel = runs.where(F.col("experiment") == experiment)
    if run_name is not None:
        sel = sel.where(tag(RUN_NAME) == run_name)
    for name, value in (params or {}).items():
        sel = sel.where(F.try_element_at(F.col("params"), F.lit(name)) == F.lit(str(value)))
    return (sel.select("run_id", "experiment", tag(RUN_NAME).alias("run_name"),
                       *[metric(m).alias(m) for m in keys], "start_time")
            .orderBy(*[F.desc_nulls_last(m) for m in keys], "run_id").limit(1))


def best_run_checked(runs: DataFrame, experiment: str, order_metric: str = "pr_auc",
                     run_name: str | None = None) -> DataFrame:
    """``best_run`` that raises when the experiment or matching runs are
    missing (one small job each)."""
    if runs.where(F.col("experiment") == experiment).isEmpty():
        raise ValueError(f"Experiment '{experiment}' not found")
    res = best_run(runs, experiment, order_metric, run_name)
    if res.isEmpty():
        raise RuntimeError(f"No runs found in experiment '{experiment}'")
    return res


def champion_decision(runs: DataFrame, experiment: str, candidate_run: str,
                      score_metric: str = "test_pr_auc") -> DataFrame:
    """Candidate is champion when its score beats the best non-null score of
    the experiment's other parent runs, or when there is no such score; a
    candidate without a score is rejected.
    One row: run_id, candidate_score, historical_best (0 when none),
    model_status."""
    parents = runs.where((F.col("experiment") == experiment) & tag(PARENT).isNull())
    cand = parents.where(F.col("run_id") == candidate_run).select(
        "run_id", metric(score_metric).alias("candidate_score"))
    others = parents.where(F.col("run_id") != candidate_run) \
        .select(metric(score_metric).alias("s")).where(F.col("s").isNotNull() & ~F.isnan("s"))
    best = others.select(F.max("s")).scalar()
    score = F.col("candidate_score")
    champion = score.isNotNull() & ~F.isnan(score) & (best.isNull() | (score > best))
    return cand.select("run_id", "candidate_score",
                       F.coalesce(best, F.lit(0.0)).alias("historical_best"),
                       F.when(champion, "Production_Champion").otherwise("Candidate_Rejected")
                       .alias("model_status"))


def champion_history(runs: DataFrame, score_metric: str = "test_pr_auc") -> DataFrame:
    """Running form: every parent run, in start order within its experiment,
    compared with the best score of all earlier parent runs.  The running
    max uses the bucketed helper, so a large experiment is spread over many
    tasks."""
    p = runs.where(tag(PARENT).isNull()).select(
        "experiment", "run_id", "start_time", metric(score_metric).alias("score"))
    # order: start_time, then run_id -> a sortable number per run
    ordered = p.withColumn("_t", F.unix_micros(F.col("start_time").cast("timestamp")))
    prev = running_totals(ordered.withColumn("_s", F.when(~F.isnan("score"), F.col("score"))),
                          ["experiment"], "_t", ["_s"], tiebreak=["run_id"], agg="max",
                          exclusive=True)
    best = F.col("cum__s")
    champion = F.col("score").isNotNull() & ~F.isnan("score") & (best.isNull() | (F.col("score") > best))
    return prev.select("experiment", "run_id", "start_time", "score",
                       F.coalesce(best, F.lit(0.0)).alias("historical_best"),
                       F.when(champion, "Production_Champion").otherwise("Candidate_Rejected")
                       .alias("model_status"))


def append_runs(runs: DataFrame, new_runs: DataFrame) -> DataFrame:
    """Add runs (missing columns become null)."""
    return runs.unionByName(new_runs, allowMissingColumns=True)


def remove_recent_runs(runs: DataFrame, experiment: str, count: int) -> DataFrame:
    """The run table without the ``count`` latest runs of an experiment
    (ties on start_time broken by run_id)."""
    recent = (runs.where(F.col("experiment") == experiment)
              .orderBy(F.desc("start_time"), F.desc("run_id")).limit(count).select("run_id"))
    return runs.join(F.broadcast(recent), "run_id", "left_anti")  # at most ``count`` rows
