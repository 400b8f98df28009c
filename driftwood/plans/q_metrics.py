"""Classification-metric queries (M1-M8) on scored documents."""

from __future__ import annotations

from driftwood.operators import metrics as M
from driftwood.plans.catalog import query
from driftwood.plans.common import SCORED_SQL, rounded, scored_documents

S = "WITH " + SCORED_SQL

_COUNTS = """c AS (SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
                  count(*) FILTER (WHERE label <> 1 AND prediction = 1) AS fp,
                  count(*) FILTER (WHERE label <> 1 AND prediction <> 1) AS tn,
                  count(*) FILTER (WHERE label = 1 AND prediction <> 1) AS fn,
                  count(*) AS n FROM scored)"""

_THRESHOLD_SELECT = """round(coalesce((tp + tn) / nullif(n, 0), 0), 6) AS accuracy,
       round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_score"""

_CUM = """pv AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos,
                    count(*) FILTER (WHERE label <> 1) AS neg
             FROM scored WHERE score IS NOT NULL GROUP BY score),
cum AS (SELECT score, pos, neg,
               sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
               sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM pv)"""

_RANK_SELECT = """round(sum(neg * (tp - pos + 0.5 * pos)) / (any_value(P) * any_value(N)), 6) AS roc_auc,
       round(sum(pos * tp / (tp + fp)) / any_value(P), 6) AS pr_auc"""


@query("confusion_matrix", oracle=f"""{S},
g AS (SELECT a.actual, p.predicted FROM (VALUES (0), (1)) a(actual), (VALUES (0), (1)) p(predicted))
SELECT g.actual, g.predicted, count(s.doc_id) AS n
FROM g LEFT JOIN scored s ON s.label = g.actual AND s.prediction = g.predicted
GROUP BY g.actual, g.predicted""")
def confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(scored_documents(spark, sf_dir), "label", "prediction")


@query("threshold_metrics", oracle=f"""{S}, {_COUNTS}
SELECT {_THRESHOLD_SELECT} FROM c""")
def threshold_metrics(spark, sf_dir):
    return rounded(M.threshold_metrics(scored_documents(spark, sf_dir), "label", "prediction"))


def _report_sql() -> str:
    rows = []
    for c in (0, 1):
        rows.append(f"""SELECT '{c}' AS label,
  coalesce(count(*) FILTER (WHERE label = {c} AND prediction = {c}) / nullif(count(*) FILTER (WHERE prediction = {c}), 0), 0) AS precision,
  coalesce(count(*) FILTER (WHERE label = {c} AND prediction = {c}) / nullif(count(*) FILTER (WHERE label = {c}), 0), 0) AS recall,
  coalesce(2 * count(*) FILTER (WHERE label = {c} AND prediction = {c}) / nullif(count(*) FILTER (WHERE prediction = {c}) + count(*) FILTER (WHERE label = {c}), 0), 0) AS f1_score,
  count(*) FILTER (WHERE label = {c}) AS support FROM scored""")
    return f"""{S},
per AS ({" UNION ALL ".join(rows)}),
tot AS (SELECT count(*) AS n, count(*) FILTER (WHERE label = prediction) AS correct FROM scored)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1_score, 6) AS f1_score, CAST(support AS BIGINT) AS support FROM per
UNION ALL SELECT 'accuracy', NULL, NULL, round(coalesce(correct / nullif(n, 0), 0), 6), n FROM tot
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6),
                 (SELECT n FROM tot) FROM per
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / (SELECT n FROM tot), 6),
                 round(sum(recall * support) / (SELECT n FROM tot), 6),
                 round(sum(f1_score * support) / (SELECT n FROM tot), 6), (SELECT n FROM tot) FROM per"""


@query("classification_report", oracle=_report_sql())
def classification_report(spark, sf_dir):
    return rounded(M.classification_report(scored_documents(spark, sf_dir), "label", "prediction"))


@query("roc_curve", oracle=f"""{S}, {_CUM}
SELECT score AS threshold, round(coalesce(fp / nullif(N, 0), 0), 6) AS fpr,
       round(coalesce(tp / nullif(P, 0), 0), 6) AS tpr FROM cum""")
def roc_curve(spark, sf_dir):
    return rounded(M.roc_curve(scored_documents(spark, sf_dir), "label", "score"))


@query("pr_curve", oracle=f"""{S}, {_CUM}
SELECT score AS threshold, round(tp / (tp + fp), 6) AS precision,
       round(coalesce(tp / nullif(P, 0), 0), 6) AS recall FROM cum""")
def pr_curve(spark, sf_dir):
    return rounded(M.pr_curve(scored_documents(spark, sf_dir), "label", "score"))


@query("ranking_metrics", oracle=f"""{S}, {_CUM}
SELECT {_RANK_SELECT} FROM cum""")
def ranking_metrics(spark, sf_dir):
    return rounded(M.ranking_metrics(scored_documents(spark, sf_dir), "label", "score"))


@query("evaluate_all", oracle=f"""{S}, {_COUNTS}, {_CUM},
r AS (SELECT {_RANK_SELECT} FROM cum)
SELECT {_THRESHOLD_SELECT}, r.roc_auc, r.pr_auc FROM c, r""")
def evaluate_all(spark, sf_dir):
    return rounded(M.evaluate(scored_documents(spark, sf_dir), "label", "prediction", "score"))
