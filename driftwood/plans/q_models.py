"""Model queries (L1-L16) on customer360.  They depend on fitted models,
so they have no SQL oracle (rows-only check); their invariants are tested
in tests/test_models.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwood.operators import boosting
from driftwood.operators import explain as X
from driftwood.operators import models as L
from driftwood.operators import newton
from driftwood.operators import preprocess as E
from driftwood.operators.splits import stratified_split
from driftwood.plans.catalog import query
from driftwood.plans.common import rounded
from driftwood.plans.customer360 import C360_CATEGORIES, customer360, customer360_sql
from driftwood.plans.q_preprocess import REGISTRY
from driftwood.session import cut_lineage

LABEL, KEY = "Exited", "CustomerId"
GBT = dict(n_estimators=10, max_depth=3, learning_rate=0.1, subsample=0.97, colsample=1.0)
_CACHE: dict = {}


def _key(spark, what: str, sf_dir: str) -> tuple:
    """Memo key: a new Spark application never sees another one's objects."""
    return (spark.sparkContext.applicationId, what, sf_dir)


def _data(spark, sf_dir):
    """customer360 with a stratified split column, written to the shared
    checkpoint folder: every model query fits several times on it, and the tasks
    of a fit carry (and report to the driver) nothing of the joins behind it."""
    key = _key(spark, "data", sf_dir)
    if key not in _CACHE:
        c = customer360(spark, sf_dir).withColumn(LABEL, F.col(LABEL).cast("double"))
        rows = stratified_split(c, LABEL, KEY, test_size=0.2, seed=43).cache()
        _CACHE[key] = cut_lineage(rows)  # in the partitions of the cached rows: fits draw their subsamples by these
        rows.unpersist()
    return _CACHE[key]


def _layout():
    return E.layout_from_registry(REGISTRY)


def _fitted(spark, sf_dir):
    """Boosted-tree pipeline fitted on the train split (memoised per folder)."""
    key = _key(spark, "model", sf_dir)
    if key not in _CACHE:
        data = _data(spark, sf_dir)
        pipe = L.build_pipeline(_layout(), L.boosted_trees(label=LABEL, **GBT), C360_CATEGORIES)
        _CACHE[key] = pipe.fit(data.where(F.col("split") == "train"))
    return _CACHE[key]


@query("baseline_zoo")
def baseline_zoo(spark, sf_dir):
    data = _data(spark, sf_dir)
    train, test = data.where(F.col("split") == "train"), data.where(F.col("split") == "test")
    kinds = ["logistic_regression", "decision_tree", "random_forest", "boosted_trees"]

    def fit(kind):
        params = GBT if kind == "boosted_trees" else {}
        return L.build_pipeline(_layout(), L.classifier(kind, label=LABEL, **params),
                                C360_CATEGORIES).fit(train)

    out = None
    for kind, model in zip(kinds, L._parallel(fit, kinds, 4)):
        row = L.evaluate_model(model, test, LABEL).select(F.lit(kind).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("cv_boosted_trees")
def cv_boosted_trees(spark, sf_dir):
    data = _data(spark, sf_dir).where(F.col("split") != "test")
    pipe = L.build_pipeline(_layout(), L.boosted_trees(label=LABEL, **GBT), C360_CATEGORIES)
    cv = L.cross_validate(data, LABEL, KEY, pipe, k=5)
    return cv.unionByName(cv.agg(F.lit(-1).alias("fold"), F.avg("pr_auc").alias("pr_auc")))


@query("test_evaluation")
def test_evaluation(spark, sf_dir):
    data = _data(spark, sf_dir)
    return L.evaluate_model(_fitted(spark, sf_dir), data.where(F.col("split") == "test"), LABEL)


@query("batch_predict")
def batch_predict(spark, sf_dir):
    return L.batch_predict(_fitted(spark, sf_dir), customer360(spark, sf_dir), KEY)


@query("feature_importance")
def feature_importance(spark, sf_dir):
    return L.feature_importance(_fitted(spark, sf_dir))


def _shap(spark, sf_dir, only=None):
    model = _fitted(spark, sf_dir)
    rows = customer360(spark, sf_dir)
    scored = model.transform(rows if only is None else rows.where(only))
    names = L._assembled_names(model)
    return X.shap_values(model.stages[-1], scored, KEY, names)


@query("shap_values")
def shap_values(spark, sf_dir):
    return _shap(spark, sf_dir)


@query("shap_global")
def shap_global(spark, sf_dir):
    return X.global_importance(_shap(spark, sf_dir), 20)


@query("shap_beeswarm")
def shap_beeswarm(spark, sf_dir):
    return X.beeswarm(_shap(spark, sf_dir), 20)


@query("shap_waterfall")
def shap_waterfall(spark, sf_dir):
    first = customer360(spark, sf_dir).agg(F.min(KEY)).first()[0]
    return X.waterfall(_shap(spark, sf_dir, F.col(KEY) == first), KEY, first, 15)


@query("shap_dependence")
def shap_dependence(spark, sf_dir):
    return X.dependence(_shap(spark, sf_dir), "num__Age")


SMALL_LAYOUT = E.Layout(one_hot=("Gender",), scaled=("Age", "Balance", "WealthScore"),
                        passthrough=("IsActiveMember", "is_germany"))


@query("forward_selection")
def forward_selection(spark, sf_dir):
    data = _data(spark, sf_dir).where(F.col("split") == "train")
    return L.sequential_selection(data, LABEL, KEY, SMALL_LAYOUT, "logistic_regression",
                                  k_features=2, forward=True, folds=3,
                                  categories=C360_CATEGORIES)


@query("staged_search")
def staged_search(spark, sf_dir):
    data = _data(spark, sf_dir).where(F.col("split") == "train")
    space = L.SearchSpace({"n_estimators": (5, 15), "learning_rate": (0.05, 0.3),
                           "subsample": (0.6, 1.0), "scale_pos_weight": (1.0, 2.0)})
    return L.staged_search(data, LABEL, KEY, _layout(), space, stages=(6, 3), folds=3,
                           categories=C360_CATEGORIES)


@query("selection_sweep")
def selection_sweep(spark, sf_dir):
    """Selection for each (model, direction, size) and the best row flagged."""
    data = _data(spark, sf_dir).where(F.col("split") == "train")
    layout = E.Layout(scaled=("Age", "Balance", "WealthScore"), passthrough=("IsActiveMember",))
    sweep = L.selection_sweep(data, LABEL, KEY, layout, ["decision_tree"], [2], folds=2,
                              categories=C360_CATEGORIES)
    best = L.best_selection(sweep).select("model", "direction", "n_features",
                                          F.lit(True).alias("is_best"))
    return sweep.join(best, ["model", "direction", "n_features"], "left") \
        .withColumn("is_best", F.coalesce("is_best", F.lit(False)))


# --- many logistic regressions at once: closed forms as SQL twins ---

BINARY = ["HasCrCard", "male", "building"]
#: customer360 with yes/no columns and folds that SQL can name too.
_BINARY_SQL = f"""WITH {customer360_sql()},
d AS (SELECT CAST(Exited AS INTEGER) AS y, CustomerId % 5 AS fold, CAST(HasCrCard AS INTEGER) AS HasCrCard,
             CAST(Gender = 'Male' AS INTEGER) AS male, CAST(lower("Card Type") = 'building' AS INTEGER) AS building
      FROM customer360),
x AS (SELECT y, fold, unnest(['HasCrCard', 'male', 'building']) AS feature, unnest([HasCrCard, male, building]) AS v FROM d),
k AS (SELECT unnest(range(5)) AS out_fold),
r AS (SELECT feature, out_fold, avg(y) FILTER (WHERE v = 0) AS r0, avg(y) FILTER (WHERE v = 1) AS r1
      FROM x JOIN k ON x.fold <> k.out_fold GROUP BY ALL)"""


def _binary(spark, sf_dir):
    return customer360(spark, sf_dir).select(
        F.col(LABEL).cast("double").alias("y"), (F.col(KEY) % 5).cast("int").alias("fold"),
        F.col("HasCrCard").cast("double").alias("HasCrCard"), (F.col("Gender") == "Male").cast("double").alias("male"),
        (F.lower("Card Type") == "building").cast("double").alias("building"))


@query("newton_binary_models", oracle=_BINARY_SQL + """
SELECT feature, CAST(out_fold AS INTEGER) AS fold, round(ln(r0 / (1 - r0)), 6) AS intercept,
       round(ln(r1 / (1 - r1)) - ln(r0 / (1 - r0)), 6) AS coefficient FROM r""")
def newton_binary_models(spark, sf_dir):
    """One-column logistic regressions of every fold, fitted together: a yes/no
    column has its maximum likelihood in closed form."""
    fits = newton.fit_many(_binary(spark, sf_dir), "y", [[c] for c in BINARY], "fold", list(range(5)), ridge=0.0)
    rows = [(f.columns[0], f.fold, f.intercept, f.coefficients[0]) for f in fits]
    return rounded(spark.createDataFrame(rows, "feature string, fold int, intercept double, coefficient double"))


@query("newton_cv_scores", oracle=_BINARY_SQL + """,
s AS (SELECT x.feature, x.fold, y, CASE WHEN (v = 1) = (r1 > r0) THEN 1 ELSE 0 END AS high
      FROM x JOIN r ON x.feature = r.feature AND x.fold = r.out_fold),
c AS (SELECT feature, fold, sum(y) AS p, sum(y * high) AS tp, sum(high) AS n_high, count(*) AS n FROM s GROUP BY ALL)
SELECT feature, CAST(fold AS INTEGER) AS fold,
       round((CASE WHEN n_high > 0 THEN tp * tp / n_high ELSE 0 END + (p - tp) * p / n) / p, 6) AS pr_auc
FROM c WHERE p > 0""")
def newton_cv_scores(spark, sf_dir):
    """Held-out average precision of the same models: two scores a fold."""
    scores = newton.cv_scores(_binary(spark, sf_dir), "y", [[c] for c in BINARY], "fold", list(range(5)), ridge=0.0)
    rows = [(c, k, v) for c, s in zip(BINARY, scores) for k, v in s.items()]
    return rounded(spark.createDataFrame(rows, "feature string, fold int, pr_auc double"))


@query("boosted_stump", oracle=f"""WITH {customer360_sql()},
d AS (SELECT CAST(Exited AS INTEGER) AS y, CAST(HasCrCard AS INTEGER) AS HasCrCard,
             CAST(Gender = 'Male' AS INTEGER) AS male, CAST(lower("Card Type") = 'building' AS INTEGER) AS building
      FROM customer360),
base AS (SELECT avg(y) AS p0 FROM d),
x AS (SELECT y, unnest([0, 1, 2]) AS c, unnest(['HasCrCard', 'male', 'building']) AS feature,
             unnest([HasCrCard, male, building]) AS v FROM d),
s AS (SELECT c, feature, sum(p0 - y) FILTER (WHERE v = 0) AS gl, p0 * (1 - p0) * count(*) FILTER (WHERE v = 0) AS hl,
             sum(p0 - y) FILTER (WHERE v = 1) AS gr, p0 * (1 - p0) * count(*) FILTER (WHERE v = 1) AS hr
      FROM x, base GROUP BY c, feature, p0),
t AS (SELECT *, sign(gl) * greatest(abs(gl) - 0.5, 0) AS tl, sign(gr) * greatest(abs(gr) - 0.5, 0) AS tr,
             sign(gl + gr) * greatest(abs(gl + gr) - 0.5, 0) AS tt FROM s),
g AS (SELECT *, 0.5 * (tl * tl / (hl + 3) + tr * tr / (hr + 3) - tt * tt / (hl + hr + 3)) - 0.001 AS gain FROM t),
b AS (SELECT * FROM g ORDER BY round(gain, 10) DESC, c LIMIT 1)
SELECT 0 AS node, feature, 0.0::DOUBLE AS threshold, round(gain, 6) AS gain, NULL::DOUBLE AS value FROM b
UNION ALL SELECT 1, NULL, NULL, NULL, round(-0.3 * tl / (hl + 3), 6) FROM b
UNION ALL SELECT 2, NULL, NULL, NULL, round(-0.3 * tr / (hr + 3), 6) FROM b""")
def boosted_stump(spark, sf_dir):
    """The first split of a regularised boosting model, and its leaves."""
    p = boosting.Parameters(n_estimators=1, max_depth=1, learning_rate=0.3, reg_lambda=3.0, reg_alpha=0.5, gamma=0.001)
    rows = _binary(spark, sf_dir).withColumn("key", F.monotonically_increasing_id())
    model = boosting.fit(rows, "y", "key", BINARY, p)
    return rounded(model.table(spark).select("node", "feature", "threshold", "gain", "value"))


@query("boosted_regularised")
def boosted_regularised(spark, sf_dir):
    """Regularised boosting of the routed inputs on the training rows: held-out
    probabilities.  Its trees are tested against brute force."""
    data = _data(spark, sf_dir)
    fitted = E.fit(L.add_features(data.where("split = 'train'"), L.required_features(_layout().columns),
                                  categories=C360_CATEGORIES), _layout())
    rows = fitted.transform(L.add_features(data, L.required_features(_layout().columns), categories=C360_CATEGORIES),
                            keep=[KEY, LABEL, "split"])
    names = fitted.output_names()
    p = boosting.Parameters(n_estimators=10, max_depth=3, subsample=0.97, colsample=0.6, scale_pos_weight=1.2)
    model = boosting.fit(rows.where("split = 'train'"), LABEL, KEY, names, p)
    return rounded(boosting.predict(rows.where("split = 'test'"), model, KEY, [LABEL]))
