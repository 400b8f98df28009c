"""Model training, validation and scoring on Spark ML.

The pipeline is ``FeatureEngineer`` (derived features, a projection) ->
``RoutedPreprocessor`` (fit: bounded parameters; transform: projection) ->
``VectorAssembler`` -> classifier.  Fits are distributed Spark ML jobs; the
driver only loops over a bounded number of folds, candidates or trials.

Metrics come from :mod:`driftwood.operators.metrics` (average precision is
the step-wise PR area, not the trapezoid of ``BinaryClassificationEvaluator``).
Boosted-tree parameters are mapped to ``GBTClassifier``; L1/L2 leaf
penalties have no counterpart, and scores differ from other boosting
libraries - parity is on semantics and metrics, not on trees.
"""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier,
                                       LogisticRegression, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.functions.features import add_features, required_features
from driftwood.operators import metrics as M
from driftwood.operators import newton
from driftwood.operators import preprocess as E
from driftwood.operators.splits import stratified_folds
from driftwood.session import cut_lineage

FEATURES = "features"


class _JsonParams(Params):
    """Stage settings kept as one JSON string param, so the stage saves and
    loads with Spark ML's default params persistence."""

    config = Param(Params._dummy(), "config", "stage settings as JSON",
                   typeConverter=TypeConverters.toString)

    def _set_config(self, value: dict) -> None:
        self._set(config=json.dumps(value))

    def _config(self) -> dict:
        return json.loads(self.getOrDefault(self.config)) if self.isDefined(self.config) else {}


class FeatureEngineer(Transformer, _JsonParams, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the derived features a layout needs (stateless)."""

    def __init__(self, selected: list[str] | None = None, categories: dict | None = None,
                 columns: dict | None = None):
        super().__init__()
        self._set_config({"selected": selected, "categories": categories, "columns": columns})

    def _transform(self, df: DataFrame) -> DataFrame:
        c = self._config()
        return add_features(df, c.get("selected"), columns=c.get("columns"),
                            categories=c.get("categories"))


class RoutedPreprocessor(Estimator):
    def __init__(self, layout: E.Layout, scaler: str = "standard", drop_first: bool = True):
        super().__init__()
        self.layout, self.scaler, self.drop_first = layout, scaler, drop_first

    def _fit(self, df: DataFrame) -> "RoutedPreprocessorModel":
        return RoutedPreprocessorModel(E.fit(df, self.layout, self.scaler, self.drop_first))


class RoutedPreprocessorModel(Model, _JsonParams, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, fitted: E.FittedPreprocessor | None = None):
        super().__init__()
        if fitted is not None:
            self._set_config(E.to_config(fitted))

    @property
    def fitted(self) -> E.FittedPreprocessor:
        return E.from_config(self._config())

    def _transform(self, df: DataFrame) -> DataFrame:
        # routed columns are appended; other columns (key, label) stay
        return df.select("*", *self.fitted.columns("double", impute=True))


#: Parameters each kind of model takes; any other name is an error.
KNOWN = {
    "logistic_regression": {"max_iter"},
    "decision_tree": {"max_depth"},
    "random_forest": {"n_estimators", "max_depth"},
    "boosted_trees": {"n_estimators", "max_depth", "learning_rate", "subsample", "colsample",
                      "min_child_weight", "gamma"},
}


def classifier(kind: str, label: str = "label", weight: str | None = None, seed: int = 42,
               **params):
    """The model zoo: logistic regression, decision tree, random forest,
    boosted trees; ``weight`` names a column of row weights."""
    if kind not in KNOWN:
        raise ValueError(f"unknown model kind {kind!r}")
    unknown = set(params) - KNOWN[kind]
    if unknown:
        raise ValueError(f"{kind} takes no parameter named {', '.join(sorted(unknown))}")
    common = dict(featuresCol=FEATURES, labelCol=label)
    if kind == "logistic_regression":
        m = LogisticRegression(**common, maxIter=params.get("max_iter", 2000))
    elif kind == "decision_tree":
        m = DecisionTreeClassifier(**common, seed=seed, maxDepth=params.get("max_depth", 5))
    elif kind == "random_forest":
        m = RandomForestClassifier(**common, seed=seed, numTrees=params.get("n_estimators", 100),
                                   maxDepth=params.get("max_depth", 5))
    else:
        m = boosted_trees(label=label, seed=seed, **params)
    if weight:
        m.setWeightCol(weight)
    return m


def boosted_trees(label: str = "label", seed: int = 42, n_estimators: int = 50,
                  max_depth: int = 5, learning_rate: float = 0.1, subsample: float = 1.0,
                  colsample: float = 1.0, min_child_weight: int = 2,
                  gamma: float = 0.0) -> GBTClassifier:
    """Boosted-tree parameters mapped to GBTClassifier.  Leaf penalties have
    no counterpart and are not accepted; a class weight goes through a weight
    column (``with_class_weight``)."""
    return GBTClassifier(featuresCol=FEATURES, labelCol=label, seed=seed, maxIter=int(n_estimators),
                         maxDepth=int(max_depth), stepSize=float(learning_rate),
                         subsamplingRate=float(subsample),
                         featureSubsetStrategy=str(float(colsample)) if colsample < 1 else "all",
                         minInstancesPerNode=max(1, int(min_child_weight)),
                         minInfoGain=float(gamma))


def with_class_weight(df: DataFrame, label: str, scale_pos_weight: float,
                      weight: str = "weight") -> DataFrame:
    """Positive rows weighted ``scale_pos_weight`` (boosting's class weight)."""
    return df.withColumn(weight, F.when(F.col(label) == 1, F.lit(float(scale_pos_weight)))
                         .otherwise(F.lit(1.0)))


def build_pipeline(layout: E.Layout, model, categories: dict | None = None,
                   scaler: str = "standard", columns: dict | None = None,
                   drop_first: bool = True) -> Pipeline:
    """Engineer -> preprocess -> assemble -> model (only the features the
    layout names are engineered)."""
    need = required_features(layout.columns)
    pre = RoutedPreprocessor(layout, scaler, drop_first)
    return Pipeline(stages=[FeatureEngineer(need, categories, columns), pre,
                            _LazyAssembler(), model])


class _LazyAssembler(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """VectorAssembler over the routed output columns present at transform
    time (their names are known only after the preprocessor is fitted)."""

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = [c for c in df.columns if c.split("__", 1)[0] in ("cat", "num", "pass")
                and "__" in c]
        return VectorAssembler(inputCols=cols, outputCol=FEATURES, handleInvalid="keep") \
            .transform(df)


def save_model(model: PipelineModel, path: str) -> None:
    """Persist a fitted pipeline (shared storage; Python stages keep their
    settings as JSON params)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def probability(df: DataFrame, output: str = "churn_probability") -> DataFrame:
    return df.withColumn(output, vector_to_array("probability")[1])


def evaluate_model(model: PipelineModel, df: DataFrame, label: str) -> DataFrame:
    """accuracy, precision, recall, f1_score, roc_auc, pr_auc on a table."""
    scored = probability(model.transform(df), "_p") \
        .select(F.col(label).cast("int").alias("_y"), F.col("prediction").cast("int").alias("_yhat"), "_p")
    return M.evaluate(scored, "_y", "_yhat", "_p")


def batch_predict(model: PipelineModel, df: DataFrame, key: str,
                  places: int = 4) -> DataFrame:
    """key, prediction (int), churn_probability rounded (half-up) - a map-only
    job over the input."""
    out = probability(model.transform(df))
    return out.select(F.col(key), F.col("prediction").cast("int").alias("prediction"),
                      F.round("churn_probability", places).alias("churn_probability"))


def cross_validate(df: DataFrame, label: str, key: str, pipeline: Pipeline, k: int = 5,
                   seed: int = 42, parallelism: int = 4, only: list[int] | None = None) -> DataFrame:
    """Stratified k-fold: one fit per fold (``parallelism`` at a time); the
    held-out predictions of all folds (or those of ``only``) are scored in one
    average-precision job grouped by fold.  Rows: fold, pr_auc (mean via
    ``mean_score``)."""
    return _cross_validate(_folds(df, label, key, k, seed), label, pipeline, k, parallelism, only)


def _folds(df: DataFrame, label: str, key: str, k: int, seed: int) -> DataFrame:
    """``df`` with its folds, once for all fits: written to the shared checkpoint
    folder, so that the many small jobs of a fit have as many tasks as the rows
    need and none carries the plan that made them."""
    return cut_lineage(stratified_folds(df, label, key, k=k, seed=seed))


def _cross_validate(folds: DataFrame, label: str, pipeline: Pipeline, k: int, parallelism: int,
                    only: list[int] | None = None) -> DataFrame:
    """``cross_validate`` on rows that have their ``fold``."""
    wanted = list(range(k)) if only is None else list(only)
    models = _parallel(lambda f: pipeline.fit(folds.where(F.col("fold") != f)), wanted, parallelism)
    held = None
    for f, model in zip(wanted, models):
        part = probability(model.transform(folds.where(F.col("fold") == f)), "_p") \
            .select("fold", F.col(label).cast("int").alias("_y"), "_p")
        held = part if held is None else held.unionByName(part)
    out = M.average_precision(held, "_y", "_p", by=["fold"], once=True)
    rows = out.select(F.col("fold").cast("int"), "pr_auc").orderBy("fold").collect()  # k rows
    return folds.sparkSession.createDataFrame([tuple(r) for r in rows], "fold int, pr_auc double")


def mean_score(cv: DataFrame, column: str = "pr_auc") -> float:
    """Mean over the folds that have a score (one without positives has none)."""
    return cv.agg(F.avg(column)).first()[0]


def feature_importance(model: PipelineModel) -> DataFrame:
    """Importance per assembled feature, sorted, with cumulative and
    relative share (one row per feature: small by construction)."""
    from driftwood.operators.topk import cumulative_share
    tree = model.stages[-1]
    names = [c for c in _assembled_names(model)]
    imp = tree.featureImportances.toArray().tolist()
    spark = _spark()
    df = spark.createDataFrame(list(zip(names, [float(x) for x in imp])),
                               "feature string, importance double")
    return cumulative_share(df, "importance", "feature").orderBy(F.desc("importance"), "feature")


def _assembled_names(model: PipelineModel) -> list[str]:
    pre = next(s for s in model.stages if isinstance(s, RoutedPreprocessorModel))
    return pre.fitted.output_names()


def _spark():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


# --- feature selection and search (driver loops over bounded candidates) -----

def _parallel(fn, items: list, parallelism: int) -> list:
    """Run independent Spark jobs from a few driver threads (Spark schedules
    concurrent jobs); results keep the input order."""
    if parallelism <= 1 or len(items) <= 1:
        return [fn(x) for x in items]
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return list(pool.map(fn, items))


def sequential_selection(df: DataFrame, label: str, key: str, layout: E.Layout, kind: str,
                         k_features: int, forward: bool = True, folds: int = 5,
                         categories: dict | None = None, seed: int = 42,
                         parallelism: int = 4) -> DataFrame:
    """Greedy forward / backward selection over the routed output columns
    (non-floating), scored by mean CV average precision.  Every candidate
    of every step is evaluated (``parallelism`` candidates at a time; logistic
    regressions of all candidates and folds together, see ``newton``); the
    transformed table is written once.  Scores count to 12 places, so that the
    choice doesn't depend on the order in which Spark sums; ties go to the
    earlier column.
    Rows: step, n_features, features (array), pr_auc_cv."""
    need = required_features(layout.columns)
    base = add_features(df, need, categories=categories)
    fitted = E.fit(base, layout)
    names = fitted.output_names()
    if not 0 < k_features <= len(names):
        raise ValueError(f"k_features must be between 1 and the {len(names)} columns")
    data = fitted.transform(base, keep=[key, label], impute=True)
    data = _folds(data, label, key, folds, seed)
    current = [] if forward else list(names)
    history = []
    step = 0
    while (len(current) < k_features) if forward else (len(current) > k_features):
        step += 1
        options = [c for c in names if c not in current] if forward else list(current)
        sets = [(cand, current + [cand] if forward else [c for c in current if c != cand])
                for cand in options]
        if kind == "logistic_regression":  # all candidates and folds in one aggregation per step
            scores = newton.mean_scores(data, label, [cols for _, cols in sets], "fold", list(range(folds)))
        else:
            scores = _parallel(lambda cs: _cv_ap(data, label, cs[1], kind, folds, seed), sets,
                               parallelism)
        scored = [(sc, cand, cols) for sc, (cand, cols) in zip(scores, sets)]
        best = max(scored, key=lambda t: (-1.0 if t[0] is None else t[0], -names.index(t[1])))
        current = best[2]
        history.append((step, len(current), current, best[0]))
    spark = df.sparkSession
    return spark.createDataFrame(history, "step int, n_features int, features array<string>, pr_auc_cv double")


def _cv_ap(data: DataFrame, label: str, cols: list[str], kind: str, folds: int, seed: int) -> float:
    return _cv_ap_model(data, label, cols, classifier(kind, label=label, seed=seed), folds)


def selection_sweep(df: DataFrame, label: str, key: str, layout: E.Layout,
                    kinds: list[str], sizes: list[int], folds: int = 5,
                    categories: dict | None = None, seed: int = 42,
                    parallelism: int = 4) -> DataFrame:
    """Selection for every (model, direction, size): rows model, direction,
    n_features, pr_auc_cv, features (sorted).  One greedy path per model and
    direction passes through every size.  ``best_selection`` picks the top
    row."""
    out = None
    for kind in kinds:
        for direction, forward in (("Forward", True), ("Backward", False)):
            path = sequential_selection(df, label, key, layout, kind, max(sizes) if forward else min(sizes),
                                        forward, folds, categories, seed, parallelism)
            part = path.where(F.col("n_features").isin(list(sizes))).select(
                F.lit(kind).alias("model"), F.lit(direction).alias("direction"), "n_features", "pr_auc_cv",
                F.array_sort("features").alias("features"))
            out = part if out is None else out.unionByName(part)
    return out


def best_selection(sweep: DataFrame) -> DataFrame:
    return sweep.orderBy(F.desc_nulls_last("pr_auc_cv"), "model", "direction", "n_features").limit(1)


#: What a parameter may be at all, whatever range is suggested,
#: and the parameters that are drawn on a logarithmic scale.
LIMITS = {"n_estimators": (1, None), "max_depth": (1, 30), "learning_rate": (1e-5, 1.0),
          "subsample": (0.1, 1.0), "colsample": (0.1, 1.0), "gamma": (0.0, None),
          "min_child_weight": (1, None), "scale_pos_weight": (0.1, None)}
LOG_SCALE = frozenset({"learning_rate"})
SCALERS = ("standard", "minmax", "robust")


@dataclass(frozen=True)
class SearchSpace:
    ranges: dict  # parameter -> (low, high); ints stay ints

    def __post_init__(self):
        unknown = set(self.ranges) - set(LIMITS)
        if unknown:
            raise ValueError(f"no such parameter: {', '.join(sorted(unknown))}")

    def re_aimed(self, suggested: dict) -> SearchSpace:
        """A space with the suggested ranges; parameters without a
        suggestion keep this space's."""
        return SearchSpace({**self.ranges, **{k: v for k, v in suggested.items() if k in self.ranges}})

    def bounds(self, name: str) -> tuple:
        """The range inside the parameter's limits; whole if the parameter is."""
        lo, hi = self.ranges[name]
        least, most = LIMITS[name]
        inside = lambda x: max(least, x if most is None else min(most, x))
        lo, hi = inside(lo), inside(hi)
        return (int(round(lo)), int(round(hi))) if isinstance(least, int) else (float(lo), float(hi))


def random_trials(space: SearchSpace, n: int, seed: int = 42) -> list[dict]:
    """n draws: numeric parameters, a scaler and an encoder (first level
    dropped or not)."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        p = {"scaler": rnd.choice(SCALERS), "drop_first": rnd.random() < 0.5}
        for name in space.ranges:
            lo, hi = space.bounds(name)
            if isinstance(lo, int):
                p[name] = rnd.randint(lo, hi)
            elif name in LOG_SCALE:
                p[name] = math.exp(rnd.uniform(math.log(lo), math.log(hi)))
            else:
                p[name] = rnd.uniform(lo, hi)
        out.append(p)
    return out


#: Candidates that a guided draw chooses from.
DRAWS = 24


def guided_trials(space: SearchSpace, past: DataFrame, n: int, seed: int = 42, draws: int = DRAWS) -> list[dict]:
    """n draws, each the likeliest of ``draws`` random ones by the ratio of the
    good and the other trials' densities (ties: the first); equal seeds and
    trials give equal draws.  Scaler and encoder stay as drawn."""
    from driftwood.operators.search import parzen_ratio
    pool = random_trials(space, n * draws, seed)
    cells = [(i, name, float(p[name])) for i, p in enumerate(pool) for name in space.ranges]
    candidates = past.sparkSession.createDataFrame(cells, "candidate int, parameter string, p double")
    ratio = {r["candidate"]: round(r["log_ratio"], 9) for r in parzen_ratio(past, candidates).collect()}  # n x draws rows
    pick = lambda k: max(range(k * draws, (k + 1) * draws), key=lambda i: (ratio.get(i, 0.0), -i))
    return [pool[pick(k)] for k in range(n)]


def pruned_after(means: list[float], past: list[list[float]]) -> int | None:
    """The number of folds after which a trial whose running means are
    ``means`` is given up: the first where it is below the median of the
    running means that complete trials had there.  None: never."""
    for k in range(1, len(means)):
        others = sorted(m[k - 1] for m in past if len(m) >= k)
        if others:
            mid = len(others) // 2
            median = others[mid] if len(others) % 2 else (others[mid - 1] + others[mid]) / 2
            if means[k - 1] < median:
                return k
    return None


TRIAL_SCHEMA = ("stage int, number long, state string, value double, params map<string,double>, "
                "scaler string, drop_first boolean")


def staged_search(df: DataFrame, label: str, key: str, layout: E.Layout, space: SearchSpace,
                  stages: tuple[int, ...] = (200, 100, 50, 25), folds: int = 5,
                  categories: dict | None = None, seed: int = 42,
                  parallelism: int = 4, guided: bool = False, prune: bool = False) -> DataFrame:
    """Seeded search in stages: random, or from the second stage on ``guided``
    by the trials so far.  After each stage the ranges are
    re-aimed with the range-suggestion rule over all trials so far, inside
    each parameter's limits; a parameter without a suggestion returns to the
    caller's range.  The whole pipeline is fitted per fold.  With ``prune`` a
    trial of a later stage is given up after the first fold at which its running
    mean is below the median of the earlier stages' complete trials there: its
    state is PRUNED, its value that mean, and no further fold is fitted.
    Rows: stage, number, state, value (mean CV AP), params map, scaler,
    drop_first."""
    from driftwood.operators.search import suggest_ranges
    spark = df.sparkSession
    rows_of_folds = _folds(df, label, key, folds, seed)  # the same for every trial

    def score(p: dict) -> list[float]:
        """Running means over the folds, as far as the trial is followed."""
        p = dict(p)
        scaler, drop_first = p.pop("scaler"), p.pop("drop_first")
        weighted = with_class_weight(rows_of_folds, label, p.pop("scale_pos_weight", 1.0), "__weight")
        model = classifier("boosted_trees", label, weight="__weight", seed=seed, **p)
        pipe = build_pipeline(layout, model, categories, scaler, drop_first=drop_first)
        if not prune:
            return [mean_score(_cross_validate(weighted, label, pipe, folds, 1))]
        means, found = [], []
        for f in range(folds):
            one = _cross_validate(weighted, label, pipe, folds, 1, only=[f])
            found += [r["pr_auc"] for r in one.collect() if r["pr_auc"] is not None]
            means.append(math.fsum(found) / len(found) if found else 0.0)
            if pruned_after([*means, 0.0], earlier) is not None and f + 1 < folds:
                break
        return means

    rows, now, complete, earlier = [], space, [], []
    for s, n in enumerate(stages):
        past = [r for r in rows if r[2] == "COMPLETE"]
        trials = guided_trials(now, spark.createDataFrame(rows, TRIAL_SCHEMA), n, seed + s) if guided and past \
            else random_trials(now, n, seed + s)
        for p, means in zip(trials, _parallel(score, trials, parallelism)):
            numbers = {k: float(v) for k, v in p.items() if k in space.ranges}
            whole = not prune or len(means) == folds
            complete += [means] if whole else []
            rows.append((s, len(rows), "COMPLETE" if whole else "PRUNED", means[-1], numbers, p["scaler"], p["drop_first"]))
        earlier = list(complete)  # as of this stage: the same whatever trial ends first
        if s + 1 < len(stages):
            found = suggest_ranges(spark.createDataFrame(rows, TRIAL_SCHEMA)).collect()  # a row per parameter
            now = space.re_aimed({r["parameter"]: (r["suggested_min"], r["suggested_max"]) for r in found})
    return spark.createDataFrame(rows, TRIAL_SCHEMA)


def _cv_ap_model(data: DataFrame, label: str, cols: list[str], model, folds: int) -> float:
    """Mean held-out average precision over the folds of ``data`` (which
    carries a ``fold`` column): one fit per fold, one AP job for all folds."""
    vec = VectorAssembler(inputCols=cols, outputCol=FEATURES, handleInvalid="keep").transform(data)
    held = None
    for f in range(folds):
        m = model.copy().fit(vec.where(F.col("fold") != f))
        part = probability(m.transform(vec.where(F.col("fold") == f)), "_p") \
            .select("fold", F.col(label).cast("int").alias("_y"), "_p")
        held = part if held is None else held.unionByName(part)
    ap = M.average_precision(held, "_y", "_p", by=["fold"], once=True).collect()  # a row per fold
    scores = [r["pr_auc"] for r in ap if r["pr_auc"] is not None]
    # sums in Spark differ in the last digits from run to run: compare 12 places
    return round(math.fsum(scores) / len(scores), 12) if scores else None
