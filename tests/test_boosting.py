"""Regularised boosting against brute force, and what its parameters do."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwood.operators import boosting as B

COLUMNS = ["a", "b", "c"]


def rows(seed=1, n=400):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rnd.randint(0, 9), rnd.randint(0, 4) / 2, rnd.choice([1.0, 2.0, None, math.nan])
        z = 0.5 * a - 2 + (1.5 if b > 1 else 0) * (1 if c is None or math.isnan(c) else -1)
        out.append((i, float(a), b, c, 1.0 if rnd.random() < 1 / (1 + math.exp(-z)) else 0.0))
    return out


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(rows(), "id long, a double, b double, c double, y double").repartition(4)


def plainly(data, p):
    """(probabilities) of the same model, by loops over every row and value."""
    xs = [[math.nan if v is None else v for v in r[1:4]] for r in data]
    y = [r[4] for r in data]
    weight = [p.scale_pos_weight if t else 1.0 for t in y]
    start = math.log(p.scale_pos_weight * sum(y) / (len(y) - sum(y)))
    margin = [start] * len(y)
    shrink = lambda g: math.copysign(max(abs(g) - p.reg_alpha, 0), g)
    score = lambda g, h: shrink(g) ** 2 / (h + p.reg_lambda)

    def grow(inside, g, h, depth):
        big_g, big_h = sum(g[i] for i in inside), sum(h[i] for i in inside)
        best = None
        if depth < p.max_depth:
            for c in range(3):
                lost = [i for i in inside if math.isnan(xs[i][c])]
                values = sorted({xs[i][c] for i in range(len(xs)) if not math.isnan(xs[i][c])})
                for to_left in ((True, False) if lost else (True,)):
                    for v in values:
                        left = [i for i in inside if (to_left if math.isnan(xs[i][c]) else xs[i][c] <= v)]
                        right = [i for i in inside if i not in set(left)]
                        gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                        gr, hr = big_g - gl, big_h - hl
                        if not left or not right or hl < p.min_child_weight or hr < p.min_child_weight:
                            continue
                        gain = round(.5 * (score(gl, hl) + score(gr, hr) - score(big_g, big_h)) - p.gamma, 10)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = (gain, left, right)
        if best is None:
            for i in inside:
                margin[i] += -p.learning_rate * shrink(big_g) / (big_h + p.reg_lambda)
        else:
            grow(best[1], g, h, depth + 1)
            grow(best[2], g, h, depth + 1)

    for _ in range(p.n_estimators):
        prob = [1 / (1 + math.exp(-m)) for m in margin]
        grow(list(range(len(y))), [w * (q - t) for w, q, t in zip(weight, prob, y)],
             [w * q * (1 - q) for w, q in zip(weight, prob)], 0)
    return [1 / (1 + math.exp(-m)) for m in margin]


@pytest.mark.parametrize("options", [
    dict(n_estimators=3, max_depth=3, min_child_weight=1.0),
    dict(n_estimators=2, max_depth=2, reg_lambda=10.0, reg_alpha=2.0, gamma=0.3, scale_pos_weight=1.7, learning_rate=0.5)])
def test_same_as_brute_force(spark, data, options):
    p = B.Parameters(**options)
    model = B.fit(data, "y", "id", COLUMNS, p)
    got = {r["id"]: r["probability"] for r in B.predict(data, model, "id").collect()}
    for i, want in enumerate(plainly(rows(), p)):
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_same_trees_wherever_the_rows_lie(spark, data):
    p = B.Parameters(n_estimators=4, max_depth=3, subsample=.7, colsample=.7)
    one = B.fit(data, "y", "id", COLUMNS, p)
    other = B.fit(data.repartition(3, "a"), "y", "id", COLUMNS, p)
    assert [t.splits.keys() for t in one.trees] == [t.splits.keys() for t in other.trees]
    for s, t in zip(one.trees, other.trees):
        assert [x[:3] for x in s.splits.values()] == [x[:3] for x in t.splits.values()]
        assert np.allclose(list(s.leaves.values()), list(t.leaves.values()), atol=1e-9)
    assert B.fit(data, "y", "id", COLUMNS, p).trees == one.trees
    used = [{x[0] for x in t.splits.values()} for t in one.trees]
    assert all(len(u) <= 2 for u in used)  # two of three columns per tree


def test_renewed_margins_change_nothing(spark, data, monkeypatch):
    p = B.Parameters(n_estimators=5, max_depth=2)
    want = B.fit(data, "y", "id", COLUMNS, p)
    monkeypatch.setattr(B, "RENEW", 2)
    got = B.fit(data, "y", "id", COLUMNS, p)
    for s, t in zip(want.trees, got.trees):
        assert [x[:3] for x in s.splits.values()] == [x[:3] for x in t.splits.values()]
        assert np.allclose(list(s.leaves.values()), list(t.leaves.values()), atol=1e-12)


def test_parameters_do_what_they_say(spark, data):
    fit = lambda **o: B.fit(data, "y", "id", COLUMNS, B.Parameters(**{"n_estimators": 1, "max_depth": 4, **o}))
    free = fit(min_child_weight=0.0)
    assert len(fit(gamma=2.0).trees[0].splits) < len(free.trees[0].splits)
    assert len(fit(min_child_weight=20.0).trees[0].splits) < len(free.trees[0].splits)
    biggest = lambda m: max(map(abs, m.trees[0].leaves.values()))
    assert biggest(fit(reg_lambda=50.0)) < biggest(free) and biggest(fit(reg_alpha=3.0)) < biggest(free)
    assert fit(reg_alpha=1e6).trees[0].leaves == {0: 0.0}
    assert fit(scale_pos_weight=3.0).start == pytest.approx(free.start + math.log(3))
    assert free.importance()["a"] > 0
    table = free.table(spark)
    assert table.where("feature is null").count() == table.where("feature is not null").count() + 1


def test_missing_values_go_where_they_gain(spark):
    df = spark.createDataFrame([(i, None if i % 2 else 1.0, float(i % 2)) for i in range(100)], "id long, a double, y double")
    model = B.fit(df, "y", "id", ["a"], B.Parameters(n_estimators=1, max_depth=1, learning_rate=1.0))
    p = {r["id"]: r["probability"] for r in B.predict(df, model, "id").collect()}
    assert min(p[i] for i in range(1, 100, 2)) > .8 > .2 > max(p[i] for i in range(0, 100, 2))
    with pytest.raises(ValueError):
        B.fit(df.where("y = 1"), "y", "id", ["a"])
    with pytest.raises(ValueError):
        B.Parameters(subsample=0)


def test_many_values_are_binned_by_quantiles(spark):
    df = spark.range(5000).select("id", (F.xxhash64("id") % 100_000 / 7).alias("a")).withColumn(
        "y", (F.col("a") > 3000).cast("double"))
    model = B.fit(df, "y", "id", ["a"], B.Parameters(n_estimators=2, max_depth=3, max_bins=32))
    assert len(model.edges[0]) == 31
    wrong = B.predict(df, model, "id", ["y"]).where((F.col("probability") > .5) != (F.col("y") == 1)).count()
    assert wrong < 5000 / 32


def test_rows_go_down_a_level_at_a_time():
    rng = np.random.default_rng(5)
    tree, missing, bins = B.Tree(), 8, rng.integers(0, 9, (500, 3)).astype(np.uint8)
    open_nodes = [0]
    for _ in range(40):  # also a chain far deeper than an array of all nodes could be
        node = open_nodes.pop(int(rng.integers(len(open_nodes))))
        tree.splits[node] = (int(rng.integers(3)), int(rng.integers(8)), bool(rng.integers(2)), 1.0)
        open_nodes += [2 * node + 1, 2 * node + 2]
    for n in open_nodes[::2]:
        tree.leaves[n] = float(rng.normal())
    want = []
    for row in bins:
        at = 0
        while at in tree.splits:
            c, last, left, _ = tree.splits[at]
            at = 2 * at + (1 if (left if row[c] == missing else row[c] <= last) else 2)
        want.append(at)
    assert tree.places(bins, missing).tolist() == want
    assert tree.values(bins, missing).tolist() == [tree.leaves.get(a, 0.0) for a in want]


def test_a_level_counts_the_columns_of_its_tree_only(spark, monkeypatch):
    seen, level = [], B._level
    monkeypatch.setattr(B, "_level", lambda *a: seen.append((a[-1], r := level(*a))) or r)
    rows = [(i, float(i % 2), float(i % 7), float(i % 5), float(i % 3), float(i % 4)) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, y double, a double, b double, c double, d double")
    B.fit(df, "y", "k", ["a", "b", "c", "d"], B.Parameters(n_estimators=2, max_depth=2, colsample=0.5))
    assert seen and all(len(w) <= 3 and not s[[c for c in range(4) if c not in w]].any()
                        for w, found in seen for s in found.values())
