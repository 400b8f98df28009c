"""Binary classification metrics over a scored table.

Threshold metrics (confusion matrix, accuracy, precision, recall, F1,
classification report) are single aggregations of conditional counts.

Ranking metrics (ROC curve and AUC, precision-recall curve, average
precision) need, for every distinct score s, the number of positives and
negatives scoring >= s.  Rows are first reduced to one row per distinct
score (partial aggregation; a tied score held by a third of the table is one
row per task), then cumulative counts come from the bucketed running-total
helper - never from a global single-partition window.

* ROC-AUC (ties count one half) = sum_s neg(s) * (pos_above(s) + pos(s)/2) / (P N)
* average precision = sum_s pos(s) * precision(s) / P, precision(s) =
  TP(>=s) / (TP(>=s) + FP(>=s)) - the step-wise (not trapezoidal) PR area.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.operators.cumulative import running_totals
from driftwood.session import cut_lineage


def _div0(a, b):
    """a / b, 0 when b is 0 (zero_division=0)."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def threshold_label(df: DataFrame, score: str, threshold: float = 0.5,
                    output: str = "prediction") -> DataFrame:
    """``score >= threshold`` as an int label."""
    return df.withColumn(output, (F.col(score) >= threshold).cast("int"))


def confusion_matrix(df: DataFrame, label: str, prediction: str,
                     classes: tuple = (0, 1)) -> DataFrame:
    """All (actual, predicted) cells of the class grid, zero-filled."""
    y, p = F.col(label), F.col(prediction)
    wide = df.groupBy(y.alias("actual")).agg(*[
        F.count_if(p == c).alias(f"p{i}") for i, c in enumerate(classes)])
    cells = F.array(*[F.struct(F.lit(c).alias("predicted"), F.col(f"p{i}").alias("n"))
                      for i, c in enumerate(classes)])
    present = wide.select("actual", F.inline(cells))
    grid = df.sparkSession.createDataFrame([(c,) for c in classes], ["actual"]) \
        .withColumn("actual", F.col("actual").cast(df.schema[label].dataType))
    full = grid.select("actual", F.inline(F.array(*[
        F.struct(F.lit(c).alias("predicted")) for c in classes])))
    return (full.join(present, ["actual", "predicted"], "left")
            .select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n")))


def _counts(df: DataFrame, label: str, prediction: str, positive=1) -> DataFrame:
    y, p = F.col(label) == positive, F.col(prediction) == positive
    return df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                  F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"),
                  F.count(F.lit(1)).alias("n"))


def threshold_metrics(df: DataFrame, label: str, prediction: str,
                      positive=1) -> DataFrame:
    """accuracy, precision, recall, f1_score (zero_division=0)."""
    c = _counts(df, label, prediction, positive)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.select(
        _div0(tp + tn, F.col("n")).alias("accuracy"),
        _div0(tp, tp + fp).alias("precision"),
        _div0(tp, tp + fn).alias("recall"),
        _div0(2 * tp, 2 * tp + fp + fn).alias("f1_score"))


def classification_report(df: DataFrame, label: str, prediction: str,
                          classes: tuple = (0, 1)) -> DataFrame:
    """Per-class precision/recall/F1/support, then accuracy, macro avg and
    weighted avg rows (accuracy row: f1_score = accuracy, support = n)."""
    y, p = F.col(label), F.col(prediction)
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(y == p).alias("correct")]
    for i, c in enumerate(classes):
        aggs += [F.count_if((y == c) & (p == c)).alias(f"tp{i}"),
                 F.count_if(p == c).alias(f"pp{i}"),
                 F.count_if(y == c).alias(f"sup{i}")]
    base = df.agg(*aggs)
    rows = []
    for i, c in enumerate(classes):
        prec = _div0(F.col(f"tp{i}"), F.col(f"pp{i}"))
        rec = _div0(F.col(f"tp{i}"), F.col(f"sup{i}"))
        f1 = _div0(2 * F.col(f"tp{i}"), F.col(f"pp{i}") + F.col(f"sup{i}"))
        rows.append((str(c), prec, rec, f1, F.col(f"sup{i}")))
    k = float(len(classes))
    macro = tuple(sum((r[j] for r in rows), F.lit(0.0)) / k for j in (1, 2, 3))
    weighted = tuple(_div0(sum((r[j] * r[4] for r in rows), F.lit(0.0)), F.col("n"))
                     for j in (1, 2, 3))
    acc = _div0(F.col("correct"), F.col("n"))
    all_rows = rows + [("accuracy", F.lit(None).cast("double"),
                        F.lit(None).cast("double"), acc, F.col("n")),
                       ("macro avg", *macro, F.col("n")),
                       ("weighted avg", *weighted, F.col("n"))]
    arr = F.array(*[F.struct(F.lit(name).alias("label"), pr.alias("precision"),
                             rc.alias("recall"), f.alias("f1_score"),
                             s.cast("long").alias("support"))
                    for name, pr, rc, f, s in all_rows])
    return base.select(F.inline(arr))


def score_counts(df: DataFrame, label: str, score: str, positive=1,
                 by: list[str] | None = None, once: bool = False) -> DataFrame:
    """Cumulative counts per distinct score (descending thresholds):
    score, pos, neg, tp (positives scoring >= score), fp, P, N; per ``by``
    group when given (e.g. one curve per CV fold).  With ``once`` the counts per
    score are written to the checkpoint folder, so that rows which are costly to
    score are scored once."""
    by = list(by or [])
    y = F.col(label) == positive
    valid = df.where(F.col(score).isNotNull())
    per = (valid.groupBy(*by, F.col(score).cast("double").alias("score"))
           .agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg")))
    if once:
        per = cut_lineage(per)
    cum = running_totals(per, by, "score", ["pos", "neg"], split_source=None if once else
                         valid.select(F.col(score).cast("double").alias("score")))
    # ascending inclusive cums -> counts at or above this score
    return cum.select(
        *by, "score", "pos", "neg",
        (F.col("total_pos") - F.col("cum_pos") + F.col("pos")).alias("tp"),
        (F.col("total_neg") - F.col("cum_neg") + F.col("neg")).alias("fp"),
        F.col("total_pos").alias("P"), F.col("total_neg").alias("N"))


def roc_curve(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score (all points kept)."""
    c = score_counts(df, label, score, positive)
    return c.select(F.col("score").alias("threshold"),
                    _div0(F.col("fp"), F.col("N")).alias("fpr"),
                    _div0(F.col("tp"), F.col("P")).alias("tpr"))


def pr_curve(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """(threshold, precision, recall) at every distinct score."""
    c = score_counts(df, label, score, positive)
    return c.select(F.col("score").alias("threshold"),
                    (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                    _div0(F.col("tp"), F.col("P")).alias("recall"))


def ranking_metrics(df: DataFrame, label: str, score: str, positive=1,
                    by: list[str] | None = None, once: bool = False) -> DataFrame:
    """roc_auc and pr_auc (average precision): one row, or one per group."""
    by = list(by or [])
    c = score_counts(df, label, score, positive, by, once)
    above = F.col("tp") - F.col("pos")
    return c.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("neg") * (above + 0.5 * F.col("pos"))),
                     F.first("P").cast("double") * F.first("N")).alias("roc_auc"),
        F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))),
                     F.first("P").cast("double")).alias("pr_auc"))


def roc_auc(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    return ranking_metrics(df, label, score, positive).select("roc_auc")


def average_precision(df: DataFrame, label: str, score: str, positive=1,
                      by: list[str] | None = None, once: bool = False) -> DataFrame:
    return ranking_metrics(df, label, score, positive, by, once).select(*(by or []), "pr_auc")


def evaluate(df: DataFrame, label: str, prediction: str, score: str | None = None,
             positive=1) -> DataFrame:
    """accuracy, precision, recall, f1_score (+ roc_auc, pr_auc when a
    score column is given) as one row."""
    thr = threshold_metrics(df, label, prediction, positive)
    if score is None:
        return thr
    rank = ranking_metrics(df, label, score, positive)
    # both sides are single rows; scalar subqueries avoid a join
    return thr.select("*", rank.select("roc_auc").scalar().alias("roc_auc"),
                      rank.select("pr_auc").scalar().alias("pr_auc"))
