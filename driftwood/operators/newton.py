"""Many logistic regressions in one aggregation.

Candidate feature sets x folds are fitted together by Newton's method: each
step is one job that reads the rows once and sums, for every model that hasn't
converged, the gradient and Hessian of its log-likelihood over the rows outside
its fold.  A task hands on one array per model; arrays are summed in two rounds
in the order of the tasks, so equal input gives equal sums to the last digit
whatever task ends first.  Only sums reach the driver: models x columns^2
numbers, whatever the number of rows.  All held-out predictions are then made in
one job and scored in another.

Columns are standardised by their mean and deviation over all rows; ``ridge``
penalises standardised weights (not the intercept) per row, which keeps
separable data and repeated columns finite.  A missing value counts as its
column's mean.  Rows without a label or a fold are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.operators import metrics as M
from driftwood.session import ship_package

RIDGE, TOLERANCE, STEPS = 1e-6, 1e-9, 60
#: Groups in which the tasks' arrays are summed first.
SALTS = 32
#: Decimals of a predicted probability that count, so that rows which are alike
#: have one score wherever they are.
PLACES = 12


@dataclass
class Fit:
    """A fitted model: column names, the fold it hasn't seen (None: none),
    weights of the standardised columns (intercept first) and of the columns."""

    columns: list[str]
    fold: int | None
    weights: np.ndarray
    intercept: float
    coefficients: list[float]
    steps: int
    converged: bool


def _matrix(batch: pa.RecordBatch, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """The batch's columns from the third on, standardised, after a column of
    ones."""
    cols = [np.ones(batch.num_rows)]
    for c, m, d in zip(batch.columns[2:], mean, deviation):
        x = (c.to_numpy(zero_copy_only=False).astype(float) - m) / d
        cols.append(np.where(np.isnan(x), 0.0, x))
    return np.column_stack(cols)


def _sums(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows, loss, gradient and upper half of the Hessian, flat."""
    s = z @ w
    p = 1.0 / (1.0 + np.exp(-np.clip(s, -700, 700)))
    hessian = (z * (p * (1 - p))[:, None]).T @ z
    return np.concatenate([[len(y), (np.logaddexp(0.0, s) - y * s).sum()], z.T @ (y - p),
                           hessian[np.triu_indices(len(w))]])


def ordered_sums(rows: DataFrame, arrays) -> dict[int, np.ndarray]:
    """Element-wise sums of the (number, array) pairs that ``arrays`` yields
    from each task's batches, by number: first in ``SALTS`` groups of tasks and
    then over these, always in the order of the tasks.  A row per number comes
    to the driver."""
    def run(batches):
        found = list(arrays(batches))
        if found:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in found], pa.int32()), pa.array([task] * len(found), pa.int32()),
                 pa.array([a for _, a in found], pa.list_(pa.float64()))], names=["number", "task", "sums"])

    def in_order():
        parts = F.transform(F.array_sort(F.collect_list(F.struct("task", "sums"))), lambda s: s["sums"])
        zeros = F.array_repeat(F.lit(0.0), F.size(F.get(parts, 0)))
        return F.aggregate(parts, zeros, lambda a, b: F.zip_with(a, b, lambda p, q: p + q))

    parts = rows.mapInArrow(run, "number int, task int, sums array<double>")
    first = parts.groupBy("number", F.pmod("task", F.lit(SALTS)).alias("salt")).agg(in_order().alias("sums"))
    whole = first.withColumnRenamed("salt", "task").groupBy("number").agg(in_order().alias("sums"))
    return {r["number"]: np.array(r["sums"]) for r in whole.collect()}


def _one_pass(rows: DataFrame, mean: np.ndarray, deviation: np.ndarray, models: dict) -> dict[int, np.ndarray]:
    """Summed arrays of the models {number: (column places, fold, weights)}."""
    shared = rows.sparkSession.sparkContext.broadcast((mean, deviation, models))

    def arrays(batches):
        mean, deviation, models = shared.value
        total = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(0).to_numpy(zero_copy_only=False)
            fold = batch.column(1).to_numpy(zero_copy_only=False)
            x = _matrix(batch, mean, deviation)
            outside = {}
            for number, (at, f, w) in models.items():
                if f not in outside:
                    outside[f] = (x, y) if f is None else (x[fold != f], y[fold != f])
                xf, yf = outside[f]
                part = _sums(xf[:, at], yf, w)
                total[number] = total[number] + part if number in total else part
        yield from total.items()

    return ordered_sums(rows, arrays)


def _checked(df: DataFrame, label: str, columns: list[str], fold: str | None) -> DataFrame:
    f = F.lit(-1) if fold is None else F.col(f"`{fold}`")
    return df.select(F.col(f"`{label}`").cast("double").alias("__y"), f.cast("int").alias("__fold"),
                     *[F.col(f"`{c}`").cast("double").alias(f"__x{i}") for i, c in enumerate(columns)]) \
        .where("__y is not null and not isnan(__y) and __fold is not null")


def fit_many(df: DataFrame, label: str, sets: list[list[str]], fold: str | None = None, folds: list[int] | None = None,
             ridge: float = RIDGE, tolerance: float = TOLERANCE, steps: int = STEPS) -> list[Fit]:
    """A model per set of columns and fold (sets first).  ``label`` is 0 or 1.
    The rows are read once per step: give a table that is cheap to read."""
    ship_package(df.sparkSession)
    columns = sorted({c for s in sets for c in s})
    place = {c: i + 1 for i, c in enumerate(columns)}
    rows = _checked(df, label, columns, fold)
    xs = [F.when(~F.isnan(f"__x{i}"), F.col(f"__x{i}")) for i in range(len(columns))]
    stats = rows.agg(F.count(F.lit(1)), *[F.avg(x) for x in xs], *[F.stddev_pop(x) for x in xs]).first()
    n = len(columns)
    mean = np.array([0.0 if m is None else m for m in stats[1:n + 1]])
    deviation = np.array([d if d else 1.0 for d in stats[n + 1:]])
    plans = [([0, *(place[c] for c in s)], f, list(s)) for s in sets for f in (folds if folds else [None])]
    weights = [np.zeros(len(at)) for at, _, _ in plans]
    trial, loss, taken = [w.copy() for w in weights], [math.inf] * len(plans), [0] * len(plans)
    move = [np.zeros(len(at)) for at, _, _ in plans]
    active = set(range(len(plans))) if stats[0] else set()
    done = set()
    for step in range(1, steps + 1):
        if not active:
            break
        sums = _one_pass(rows, mean, deviation, {i: (plans[i][0], plans[i][1], trial[i]) for i in active})
        for i in sorted(active):
            if i not in sums:  # no row outside its fold
                active.discard(i)
                continue
            d, s, w = len(trial[i]), sums[i], trial[i]
            penalty = np.r_[0.0, np.full(d - 1, ridge * s[0])]
            now = s[1] + 0.5 * (penalty * w * w).sum()
            taken[i] = step
            if now > loss[i] + 1e-12 * abs(loss[i]) and np.abs(move[i]).max() > tolerance:
                move[i] = move[i] / 2  # too far: half of the way
                trial[i] = weights[i] + move[i]
                continue
            weights[i], loss[i] = w, now
            hessian = np.zeros((d, d))
            hessian[np.triu_indices(d)] = s[2 + d:]
            hessian = hessian + np.triu(hessian, 1).T + np.diag(penalty)
            move[i] = np.linalg.lstsq(hessian, s[2:2 + d] - penalty * w, rcond=None)[0]
            trial[i] = w + move[i]
            if np.abs(move[i]).max() <= tolerance:
                weights[i] = trial[i]
                active.discard(i)
                done.add(i)
    out = []
    for i, (at, f, names) in enumerate(plans):
        w = weights[i]
        own = [a - 1 for a in at[1:]]
        coefficients = w[1:] / deviation[own]
        out.append(Fit(names, f, w, float(w[0] - (coefficients * mean[own]).sum()), coefficients.tolist(),
                       taken[i], i in done))
    return out


def predict_many(df: DataFrame, label: str, fits: list[Fit], fold: str | None = None) -> DataFrame:
    """(model, fold, y, p): for every row the probability by each model of the
    row's own fold (all models, if they have none)."""
    ship_package(df.sparkSession)
    columns = sorted({c for f in fits for c in f.columns})
    place = {c: i + 1 for i, c in enumerate(columns)}
    models = [([0, *(place[c] for c in f.columns)], f.fold, np.r_[f.intercept, f.coefficients]) for f in fits]
    # a missing value is the column's mean, so its place in the sum is there
    filled = {c: F.avg(F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`"))) for c in columns}
    row = df.agg(*filled.values()).first()
    mean = np.array([0.0 if m is None else m for m in row])
    shared = df.sparkSession.sparkContext.broadcast((models, mean))

    def run(batches):
        models, mean = shared.value
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int32)
            fold = batch.column(1).to_numpy(zero_copy_only=False)
            x = _matrix(batch, np.zeros(len(mean)), np.ones(len(mean)))
            for i, c in enumerate(batch.columns[2:]):
                v = c.to_numpy(zero_copy_only=False).astype(float)
                x[:, i + 1] = np.where(np.isnan(v), mean[i], v)
            for number, (at, f, w) in enumerate(models):
                mine = np.ones(len(y), bool) if f is None else fold == f
                p = 1.0 / (1.0 + np.exp(-np.clip(x[mine][:, at] @ w, -700, 700)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(mine.sum(), number, np.int32)), pa.array(fold[mine].astype(np.int32)),
                     pa.array(y[mine]), pa.array(np.round(p, PLACES))], names=["model", "fold", "y", "p"])

    return _checked(df, label, columns, fold).mapInArrow(run, "model int, fold int, y int, p double")


def cv_scores(df: DataFrame, label: str, sets: list[list[str]], fold: str, folds: list[int],
              ridge: float = RIDGE) -> list[dict[int, float]]:
    """Per set of columns {fold: held-out average precision}; a fold without
    positives has none.  A job per Newton step, one for the predictions'
    scores, however many sets there are."""
    fits = fit_many(df, label, sets, fold, folds, ridge)
    held = predict_many(df, label, fits, fold)
    scores = M.average_precision(held, "y", "p", by=["model"]).collect()  # a row per model
    out: list[dict[int, float]] = [{} for _ in sets]
    for r in scores:
        if r["pr_auc"] is not None:
            out[r["model"] // len(folds)][folds[r["model"] % len(folds)]] = round(r["pr_auc"], PLACES)
    return out


def mean_scores(df: DataFrame, label: str, sets: list[list[str]], fold: str, folds: list[int],
                ridge: float = RIDGE) -> list[float | None]:
    """Mean held-out average precision per set of columns."""
    return [math.fsum(s.values()) / len(s) if s else None for s in cv_scores(df, label, sets, fold, folds, ridge)]
