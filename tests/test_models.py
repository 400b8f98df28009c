"""Model jobs: attribution additivity, scoring schema, importances, CV."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from driftwood.operators import explain as X
from driftwood.operators import models as L
from driftwood.operators import preprocess as E


@pytest.fixture(scope="module")
def data(spark):
    rnd = np.random.default_rng(0)
    n = 400
    a, b = rnd.normal(size=n), rnd.normal(size=n)
    g = rnd.integers(0, 2, size=n)
    y = ((a + 0.5 * b + 0.8 * g + rnd.normal(scale=0.7, size=n)) > 0.5).astype(float)
    rows = [(i, float(a[i]), float(b[i]) if i % 37 else None, "m" if g[i] else "f", float(y[i]))
            for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, sex string, label double").cache()


LAYOUT = E.Layout(one_hot=("sex",), scaled=("a", "b"))


def test_tree_shap_additivity(spark, data):
    pipe = L.build_pipeline(LAYOUT, L.boosted_trees(label="label", n_estimators=8, max_depth=3))
    model = pipe.fit(data)
    scored = model.transform(data)
    shap = X.shap_values(model.stages[-1], scored, "id", L._assembled_names(model))
    per_row = shap.groupBy("id").agg((F.first("base_value") + F.sum("shap")).alias("total"),
                                     F.first("margin").alias("margin"))
    raw = scored.select("id", vector_to_array("rawPrediction")[1].alias("raw"))
    rows = per_row.join(raw, "id").collect()
    assert len(rows) == 400
    for r in rows:
        assert r["total"] == pytest.approx(r["margin"], abs=1e-9)
        assert r["margin"] == pytest.approx(r["raw"], abs=1e-9)
    top = X.global_importance(shap, 2).collect()
    assert len(top) == 2
    wf = X.waterfall(shap, "id", 0, 1).collect()
    assert len(wf) == 2 and wf[-1]["feature"] == "other features"


def test_tree_shap_random_forest_additivity(spark, data):
    pipe = L.build_pipeline(LAYOUT, L.classifier("random_forest", label="label", n_estimators=5,
                                                 max_depth=3))
    model = pipe.fit(data)
    scored = model.transform(data)
    shap = X.shap_values(model.stages[-1], scored, "id", L._assembled_names(model))
    per_row = shap.groupBy("id").agg((F.first("base_value") + F.sum("shap")).alias("total"),
                                     F.first("margin").alias("margin"))
    prob = scored.select("id", vector_to_array("probability")[1].alias("p"))
    for r in per_row.join(prob, "id").collect():
        assert r["total"] == pytest.approx(r["margin"], abs=1e-9)
        assert r["margin"] == pytest.approx(r["p"], abs=1e-9)


def test_batch_predict_and_importance(spark, data):
    model = L.build_pipeline(LAYOUT, L.boosted_trees(label="label", n_estimators=5, max_depth=2)).fit(data)
    out = L.batch_predict(model, data, "id")
    assert out.columns == ["id", "prediction", "churn_probability"]
    r = out.agg(F.min("churn_probability"), F.max("churn_probability"), F.count("*")).first()
    assert 0.0 <= r[0] <= r[1] <= 1.0 and r[2] == 400
    imp = L.feature_importance(model).collect()
    assert sum(x["importance"] for x in imp) == pytest.approx(1.0)
    assert imp[-1]["cumulative"] == pytest.approx(1.0)


def test_cross_validate_and_metrics(spark, data):
    pipe = L.build_pipeline(LAYOUT, L.classifier("logistic_regression", label="label"))
    cv = L.cross_validate(data, "label", "id", pipe, k=3)
    rows = cv.collect()
    assert [r["fold"] for r in rows] == [0, 1, 2]
    assert all(0.5 < r["pr_auc"] <= 1.0 for r in rows)
    m = L.evaluate_model(pipe.fit(data), data, "label").first().asDict()
    assert set(m) == {"accuracy", "precision", "recall", "f1_score", "roc_auc", "pr_auc"}


def test_sequential_selection_backward(spark, data):
    res = L.sequential_selection(data, "label", "id", LAYOUT, "logistic_regression",
                                 k_features=2, forward=False, folds=2).collect()
    assert [r["n_features"] for r in res] == [2]
    assert len(res[0]["features"]) == 2


def test_pipeline_save_and_load(spark, data, tmp_path):
    model = L.build_pipeline(LAYOUT, L.boosted_trees(label="label", n_estimators=4, max_depth=2)).fit(data)
    path = str(tmp_path / "model")
    L.save_model(model, path)
    again = L.load_model(path)
    a = sorted(L.batch_predict(model, data, "id").collect())
    b = sorted(L.batch_predict(again, data, "id").collect())
    assert a == b
    assert L._assembled_names(again) == L._assembled_names(model)


def test_vectorised_treeshap_equals_recursion(spark, data):
    model = L.build_pipeline(LAYOUT, L.boosted_trees(label="label", n_estimators=6, max_depth=4)).fit(data)
    scored = model.transform(data)
    names = L._assembled_names(model)
    a = X.shap_values(model.stages[-1], scored, "id", names, method="paths")
    b = X.shap_values(model.stages[-1], scored, "id", names, method="recursive")
    j = a.join(b.withColumnRenamed("shap", "shap_r").select("id", "feature", "shap_r"), ["id", "feature"])
    rows = j.select("shap", "shap_r").collect()
    assert len(rows) == 400 * len(names)
    assert max(abs(r["shap"] - r["shap_r"]) for r in rows) < 1e-9


def test_selection_same_with_and_without_threads(spark, data):
    a = L.sequential_selection(data, "label", "id", LAYOUT, "logistic_regression", k_features=2,
                               forward=True, folds=2, parallelism=1).collect()
    b = L.sequential_selection(data, "label", "id", LAYOUT, "logistic_regression", k_features=2,
                               forward=True, folds=2, parallelism=4).collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_tree_export_memo_distinguishes_models_of_one_estimator(spark, data):
    est = L.boosted_trees(label="label", n_estimators=3, max_depth=2)
    pipe = L.build_pipeline(LAYOUT, est)
    m1 = pipe.fit(data.where("id % 2 = 0")).stages[-1]
    m2 = pipe.fit(data.where("id % 2 = 1")).stages[-1]
    assert m1.uid == m2.uid
    t1, t2 = X.export_trees(m1)["trees"], X.export_trees(m2)["trees"]
    assert any(not np.array_equal(a["thr"], b["thr"]) or not np.array_equal(a["value"], b["value"])
               for a, b in zip(t1, t2))


def test_search_space_clamps_and_keeps_the_callers_ranges():
    space = L.SearchSpace({"learning_rate": (0.01, 0.1), "subsample": (0.5, 1.0), "n_estimators": (5, 9)})
    wide = space.re_aimed({"learning_rate": (-0.035, 0.1), "subsample": (0.5, 1.25), "n_estimators": (-2.0, 9.4)})
    assert wide.bounds("learning_rate") == (1e-5, 0.1) and wide.bounds("subsample") == (0.5, 1.0)
    assert wide.bounds("n_estimators") == (1, 9) and space.ranges["learning_rate"] == (0.01, 0.1)
    for p in L.random_trials(wide, 200):
        assert 1e-5 <= p["learning_rate"] <= 0.1 and 0.5 <= p["subsample"] <= 1.0 and 1 <= p["n_estimators"] <= 9
    with pytest.raises(ValueError):
        L.SearchSpace({"reg_alpha": (0, 1)})
    with pytest.raises(ValueError):
        L.classifier("boosted_trees", scale_pos_weight=2)


def test_path_contributions_equal_recursion_on_a_deep_tree():
    import numpy as np
    from driftwood.operators import explain as X
    rng = np.random.default_rng(3)
    depth, m = 12, 16
    left, right, feat, thr, value, cover = [], [], [], [], [], []

    def grow(d, c):
        i = len(left)
        for col, v in ((left, -1), (right, -1), (feat, -1), (thr, 0.0), (value, rng.normal()), (cover, c)):
            col.append(v)
        if d and c > 1.0:
            f = rng.uniform(0.2, 0.8)
            feat[i], thr[i] = int(rng.integers(m)), rng.uniform(-1, 1)
            left[i] = grow(d - 1, c * f)
            right[i] = grow(d - 1, c * (1 - f))
        return i

    grow(depth, 400.0)
    t = {k: np.array(v) for k, v in dict(left=left, right=right, feature=feat, thr=thr, value=value, cover=cover).items()}
    x = rng.uniform(-1, 1, (20, m))
    fast = np.zeros((20, m + 1))
    X._batch_shap(x, X.leaf_paths(t), 1.0, fast)
    for row, got in zip(x, fast):
        slow = np.zeros(m + 1)
        X._tree_shap(row, t, slow)
        assert np.abs(slow - got).max() < 1e-9


def test_search_deals_folds_once(spark, data, monkeypatch):
    """Folds are the same for every trial: one job makes them, and fits read
    rows without the plan behind them."""
    calls, deal = [], L.stratified_folds
    monkeypatch.setattr(L, "stratified_folds", lambda *a, **k: calls.append(1) or deal(*a, **k))
    space = L.SearchSpace({"n_estimators": (1, 1)})
    found = L.staged_search(data, "label", "id", LAYOUT, space, stages=(2, 1), folds=2)
    assert found.count() == 3 and len(calls) == 1


def test_model_rows_carry_no_joins(spark):
    from driftwood.plans import q_models as Q
    plan = Q._data(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Join" not in plan and "Window" not in plan


def test_held_out_rows_are_scored_once(spark):
    from driftwood.operators import metrics as M
    scored = spark.sparkContext.accumulator(0)

    def score(batches):
        for b in batches:
            scored.add(b.num_rows)
            yield b

    df = spark.range(300).selectExpr("cast(id % 3 as int) as fold", "cast(id % 5 = 0 as int) as y", "(id * 7 % 50) / 50d as p")
    once = M.average_precision(df.mapInArrow(score, df.schema), "y", "p", by=["fold"], once=True).orderBy("fold").collect()
    assert scored.value == 300
    plain = M.average_precision(df, "y", "p", by=["fold"]).orderBy("fold").collect()
    assert [(r[0], pytest.approx(r[1], abs=1e-12)) for r in plain] == [tuple(r) for r in once]
