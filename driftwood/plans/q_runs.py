"""Run-table and search-trial queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwood.operators import runs as R
from driftwood.operators.profile import pivot_scores
from driftwood.operators.search import parzen_ratio, suggest_ranges
from driftwood.operators.topk import top_k_per_group
from driftwood.plans.catalog import query
from driftwood.plans.common import rounded
from driftwood.plans.q_checks import _folder
from driftwood.plans.runs_table import MODELS, TRIAL_PARAMS, runs, runs_sql, trials, trials_sql
from driftwood.sources import run_store

RUNS = "WITH " + runs_sql()


@query("best_runs_per_experiment", oracle=f"""{RUNS},
cand AS (SELECT * FROM runs WHERE parent_run_id IS NULL AND status = 'FINISHED'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY experiment
             ORDER BY m_test_pr_auc DESC NULLS LAST, m_best_optuna_val_pr_auc DESC NULLS LAST, run_id) AS rn
           FROM cand)
SELECT experiment, experiment_id, run_id, coalesce(run_name, 'Unnamed Model') AS run_name,
       round(coalesce(m_test_pr_auc, m_best_optuna_val_pr_auc), 6) AS test_pr_auc,
       strftime(start_time, '%Y-%m-%dT%H:%M:%S') AS date
FROM ranked WHERE rn = 1 AND coalesce(m_test_pr_auc, m_best_optuna_val_pr_auc) IS NOT NULL""")
def best_runs_per_experiment(spark, sf_dir):
    return rounded(R.best_runs_per_experiment(runs(spark, sf_dir)))


@query("experiment_summary", oracle=f"""{RUNS}
SELECT run_id, run_name, round(m_accuracy, 6) AS accuracy, round(m_precision, 6) AS precision,
       round(m_recall, 6) AS recall, round(m_f1_score, 6) AS f1_score,
       round(m_roc_auc, 6) AS roc_auc, round(m_pr_auc_cv, 6) AS pr_auc_cv, start_time
FROM runs WHERE experiment = '3-MEDIUM'""")
def experiment_summary(spark, sf_dir):
    return rounded(R.experiment_summary(runs(spark, sf_dir), "3-MEDIUM"))


@query("best_run_in_experiment", oracle=f"""{RUNS}
SELECT run_id, experiment, run_name, round(m_pr_auc, 6) AS pr_auc, start_time FROM runs
WHERE experiment = '2-HIGH' ORDER BY m_pr_auc DESC NULLS LAST, run_id LIMIT 1""")
def best_run_in_experiment(spark, sf_dir):
    return rounded(R.best_run(runs(spark, sf_dir), "2-HIGH", "pr_auc"))


@query("best_run_by_name", oracle=f"""{RUNS}
SELECT run_id, experiment, run_name, round(m_pr_auc, 6) AS pr_auc, start_time FROM runs
WHERE experiment = '2-HIGH' AND run_name = 'RandomForest'
ORDER BY m_pr_auc DESC NULLS LAST, run_id LIMIT 1""")
def best_run_by_name(spark, sf_dir):
    return rounded(R.best_run(runs(spark, sf_dir), "2-HIGH", "pr_auc", run_name="RandomForest"))


@query("champion_decision", oracle=f"""{RUNS},
parents AS (SELECT * FROM runs WHERE experiment = '4-NOT SPECIFIED' AND parent_run_id IS NULL),
cand AS (SELECT run_id, m_test_pr_auc AS candidate_score FROM parents
         ORDER BY start_time DESC, run_id DESC LIMIT 1),
hist AS (SELECT max(m_test_pr_auc) AS best FROM parents
         WHERE run_id <> (SELECT run_id FROM cand) AND m_test_pr_auc IS NOT NULL)
SELECT run_id, round(candidate_score, 6) AS candidate_score,
       round(coalesce(best, 0.0), 6) AS historical_best,
       CASE WHEN best IS NULL OR candidate_score > best THEN 'Production_Champion'
            ELSE 'Candidate_Rejected' END AS model_status
FROM cand, hist""")
def champion_decision(spark, sf_dir):
    r = runs(spark, sf_dir)
    exp = "4-NOT SPECIFIED"
    latest = (r.where((F.col("experiment") == exp) & R.tag(R.PARENT).isNull())
              .orderBy(F.desc("start_time"), F.desc("run_id")).select("run_id").first())
    return rounded(R.champion_decision(r, exp, latest["run_id"]))


@query("champion_history", oracle=f"""{RUNS},
p AS (SELECT experiment, run_id, start_time, m_test_pr_auc AS score FROM runs WHERE parent_run_id IS NULL),
h AS (SELECT *, max(score) OVER (PARTITION BY experiment ORDER BY start_time, run_id
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM p)
SELECT experiment, run_id, start_time, round(score, 6) AS score,
       round(coalesce(best, 0.0), 6) AS historical_best,
       CASE WHEN score IS NOT NULL AND (best IS NULL OR score > best) THEN 'Production_Champion'
            ELSE 'Candidate_Rejected' END AS model_status
FROM h""")
def champion_history(spark, sf_dir):
    return rounded(R.champion_history(runs(spark, sf_dir)))


@query("append_runs_counts", oracle=f"""{RUNS}
SELECT experiment, count(*) AS n_runs, count(*) FILTER (WHERE status <> 'FINISHED') AS n_without_params
FROM runs GROUP BY experiment""")
def append_runs_counts(spark, sf_dir):
    r = runs(spark, sf_dir)
    base = r.where(F.col("status") == "FINISHED")
    new = r.where(F.col("status") != "FINISHED").drop("params")
    out = R.append_runs(base, new)
    return out.groupBy("experiment").agg(F.count(F.lit(1)).alias("n_runs"),
                                         F.count_if(F.col("params").isNull()).alias("n_without_params"))


@query("remove_recent_runs", oracle=f"""{RUNS},
recent AS (SELECT run_id FROM runs WHERE experiment = '5-LOW'
           ORDER BY start_time DESC, run_id DESC LIMIT 10)
SELECT experiment, count(*) AS n_runs, max(start_time) AS latest_start
FROM runs WHERE run_id NOT IN (SELECT run_id FROM recent) GROUP BY experiment""")
def remove_recent_runs(spark, sf_dir):
    kept = R.remove_recent_runs(runs(spark, sf_dir), "5-LOW", 10)
    return kept.groupBy("experiment").agg(F.count(F.lit(1)).alias("n_runs"),
                                          F.max("start_time").alias("latest_start"))


@query("run_store_after_changes", oracle=f"""{RUNS},
recent AS (SELECT run_id FROM runs WHERE experiment = '5-LOW'
           ORDER BY start_time DESC, run_id DESC LIMIT 10)
SELECT experiment, count(*) AS n_runs, count(DISTINCT run_id) AS n_ids, max(start_time) AS latest_start
FROM runs WHERE run_id NOT IN (SELECT run_id FROM recent) GROUP BY experiment""")
def run_store_after_changes(spark, sf_dir):
    """Runs stored in two batches, one of them replayed, and the latest of an
    experiment removed: what a reader of the store then sees."""
    r, path = runs(spark, sf_dir), _folder(spark, "runs")
    for batch, part in (("finished", r.where("status = 'FINISHED'")), ("others", r.where("status <> 'FINISHED'"))):
        run_store.append(part, path, batch)
    run_store.append(r.where("status <> 'FINISHED'"), path, "others")
    run_store.remove_recent(spark, path, "5-LOW", 10)
    return run_store.read_runs(spark, path).groupBy("experiment").agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_distinct("run_id").alias("n_ids"),
        F.max("start_time").alias("latest_start"))


@query("top3_runs_per_experiment", oracle=f"""{RUNS},
r AS (SELECT experiment, run_id, m_pr_auc AS pr_auc,
             row_number() OVER (PARTITION BY experiment ORDER BY m_pr_auc DESC NULLS LAST, run_id) AS rank
      FROM runs)
SELECT experiment, run_id, round(pr_auc, 6) AS pr_auc, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def top3_runs_per_experiment(spark, sf_dir):
    r = runs(spark, sf_dir).select("experiment", "run_id", R.metric("pr_auc").alias("pr_auc"))
    return rounded(top_k_per_group(r, ["experiment"], [("pr_auc", "desc"), ("run_id", "asc")],
                                   3, salt_key="run_id"))


def _sweep(spark, sf_dir):
    r = runs(spark, sf_dir)
    return r.select(
        (F.lit(10) + F.pmod(F.second("start_time"), F.lit(5))).alias("n_features"),
        R.tag(R.RUN_NAME).alias("model"),
        F.when(R.tag(R.PARENT).isNull(), "Backward").otherwise("Forward").alias("direction"),
        R.metric("best_optuna_val_pr_auc").alias("score")) \
        .groupBy("n_features", "model", "direction").agg(F.max("score").alias("pr_auc_cv"))


_PIVOT_COLS = [f"{m}_{d}" for m in MODELS for d in ("Backward", "Forward")]


@query("sweep_pivot", oracle=f"""{RUNS},
s AS (SELECT 10 + second(start_time) % 5 AS n_features, run_name AS model,
             CASE WHEN parent_run_id IS NULL THEN 'Backward' ELSE 'Forward' END AS direction,
             m_best_optuna_val_pr_auc AS score FROM runs),
g AS (SELECT n_features, model || '_' || direction AS label, max(score) AS v FROM s GROUP BY ALL)
SELECT CAST(n_features AS INTEGER) AS n_features,
       {", ".join(f"round(max(v) FILTER (WHERE label = '{c}'), 6) AS {c}" for c in _PIVOT_COLS)}
FROM g GROUP BY n_features""")
def sweep_pivot(spark, sf_dir):
    return rounded(pivot_scores(_sweep(spark, sf_dir), "n_features", ["model", "direction"],
                                "pr_auc_cv"))


@query("best_sweep_row", oracle=f"""{RUNS},
s AS (SELECT 10 + second(start_time) % 5 AS n_features, run_name AS model,
             CASE WHEN parent_run_id IS NULL THEN 'Backward' ELSE 'Forward' END AS direction,
             m_best_optuna_val_pr_auc AS score FROM runs),
g AS (SELECT CAST(n_features AS INTEGER) AS n_features, model, direction, max(score) AS pr_auc_cv
      FROM s GROUP BY ALL)
SELECT n_features, model, direction, round(pr_auc_cv, 6) AS pr_auc_cv FROM g
ORDER BY pr_auc_cv DESC NULLS LAST, n_features, model, direction LIMIT 1""")
def best_sweep_row(spark, sf_dir):
    s = _sweep(spark, sf_dir)
    return rounded(s.orderBy(F.desc_nulls_last("pr_auc_cv"), "n_features", "model", "direction")
                   .limit(1))


_PARAMS = list(TRIAL_PARAMS)


@query("suggest_ranges", oracle=f"""WITH {trials_sql()},
complete AS (SELECT * FROM trials WHERE state = 'COMPLETE'),
thr AS (SELECT quantile_cont(value, 0.95) AS t FROM complete),
long AS (UNPIVOT (SELECT value, {", ".join(f"p_{p} AS {p}" for p in _PARAMS)} FROM complete)
         ON {", ".join(_PARAMS)} INTO NAME parameter VALUE p),
st AS (SELECT parameter, count(*) AS n, min(p) AS current_min, max(p) AS current_max
       FROM long WHERE p IS NOT NULL AND NOT isnan(p) GROUP BY parameter),
tq AS (SELECT parameter, quantile_cont(p, 0.1) AS q10, quantile_cont(p, 0.5) AS best_median,
              quantile_cont(p, 0.9) AS q90
       FROM long, thr WHERE value >= t AND p IS NOT NULL AND NOT isnan(p) GROUP BY parameter),
j AS (SELECT st.*, tq.q10, tq.best_median, tq.q90, current_max - current_min AS span
      FROM st LEFT JOIN tq ON st.parameter = tq.parameter
      WHERE n >= 5 AND current_max - current_min <> 0),
a AS (SELECT *, CASE WHEN (best_median - current_min) / span < 0.15 THEN 'move_left'
                     WHEN (best_median - current_min) / span > 0.85 THEN 'move_right'
                     WHEN (q90 - q10) / span < 0.40 THEN 'narrow' ELSE 'keep' END AS action FROM j)
SELECT parameter, round(current_min, 6) AS current_min, round(current_max, 6) AS current_max,
       round(best_median, 6) AS best_median, action,
       round(CASE action WHEN 'move_left' THEN current_min - 0.5 * span
                         WHEN 'narrow' THEN q10 - (q90 - q10) * 0.2 ELSE current_min END, 6) AS suggested_min,
       round(CASE action WHEN 'move_right' THEN current_max + 0.5 * span
                         WHEN 'narrow' THEN q90 + (q90 - q10) * 0.2 ELSE current_max END, 6) AS suggested_max
FROM a""")
def suggest_ranges_query(spark, sf_dir):
    return rounded(suggest_ranges(trials(spark, sf_dir)))


#: 25 candidates along the diagonal of the parameters' ranges.
@query("parzen_ratio_of_trials", oracle=f"""WITH {trials_sql()},
ok AS (SELECT * FROM trials WHERE state = 'COMPLETE' AND value IS NOT NULL AND NOT isnan(value)),
thr AS (SELECT quantile_cont(value, 0.75) AS t FROM ok),
long AS ({" UNION ALL ".join(f"SELECT value >= t AS good, '{p}' AS parameter, p_{p} AS p FROM ok, thr" for p in TRIAL_PARAMS)}),
span AS (SELECT parameter, min(p) AS lo, max(p) AS hi FROM long GROUP BY parameter HAVING min(p) < max(p)),
side AS (SELECT l.parameter, l.good, hi - lo AS width, count(*) AS n,
                greatest(stddev_pop(p) * pow(count(*), -0.2), max(hi - lo) / 100) AS h
         FROM long l JOIN span s ON l.parameter = s.parameter GROUP BY ALL),
cand AS (SELECT CAST(i AS INTEGER) AS candidate, parameter, lo + i * (hi - lo) / 24 AS x FROM span, range(25) t(i)),
vals AS (SELECT parameter, good, p, count(*) AS w FROM long GROUP BY ALL),
mass AS (SELECT c.candidate, s.parameter, s.good, s.width, s.n,
                sum(w * exp(-0.5 * pow((x - p) / h, 2)) / (h * sqrt(2 * pi()))) AS k
         FROM cand c JOIN side s ON c.parameter = s.parameter JOIN vals v ON v.parameter = s.parameter AND v.good = s.good
         GROUP BY ALL)
SELECT candidate, round(sum(CASE WHEN good THEN 1 ELSE -1 END * ln((1.0 / width + k) / (n + 1.0))), 6) AS log_ratio
FROM mass GROUP BY candidate""")
def parzen_ratio_of_trials(spark, sf_dir):
    t = trials(spark, sf_dir)
    span = t.where("state = 'COMPLETE'").select(F.explode("params").alias("parameter", "p")).groupBy("parameter").agg(
        F.min("p").alias("lo"), F.max("p").alias("hi"))
    i = F.explode(F.sequence(F.lit(0), F.lit(24)))
    points = span.select("parameter", "lo", "hi", i.alias("candidate")).select(
        "candidate", "parameter", (F.col("lo") + F.col("candidate") * (F.col("hi") - F.col("lo")) / 24).alias("p"))
    return rounded(parzen_ratio(t, points))
