"""The guided sampler and median pruning."""

import math

import pytest
from pyspark.sql import functions as F

from driftwood.operators import models as L
from driftwood.operators import preprocess as E
from driftwood.operators.search import parzen_ratio

SCHEMA = "number int, state string, value double, params map<string,double>"


def test_ratio_same_as_plain_sums(spark):
    trials = [(i, "COMPLETE" if i % 5 else "PRUNED", ((i * 37) % 100) / 100, {"a": (i * 7) % 11 / 10, "b": float(i % 3), "c": 4.0})
              for i in range(60)]
    points = [(0, {"a": .1, "b": 0.0}), (1, {"a": .9, "b": 2.0}), (2, {"a": 5.0, "b": 1.0})]
    got = {r["candidate"]: r["log_ratio"] for r in parzen_ratio(
        spark.createDataFrame(trials, SCHEMA),
        spark.createDataFrame([(i, k, v) for i, p in points for k, v in p.items()], "candidate int, parameter string, p double")).collect()}
    ok = [t for t in trials if t[1] == "COMPLETE"]
    values = sorted(t[2] for t in ok)
    h = .75 * (len(values) - 1)
    least = values[int(h)] + (h - int(h)) * (values[int(h) + 1] - values[int(h)])
    for i, point in points:
        want = 0.0
        for name, x in point.items():
            every = [t[3][name] for t in ok]
            width = max(every) - min(every)
            for good, sign in ((True, 1), (False, -1)):
                ps = [t[3][name] for t in ok if (t[2] >= least) is good]
                mean = sum(ps) / len(ps)
                band = max(math.sqrt(sum((p - mean) ** 2 for p in ps) / len(ps)) * len(ps) ** -.2, width / 100)
                s = sum(math.exp(-.5 * ((x - p) / band) ** 2) / (band * math.sqrt(2 * math.pi)) for p in ps)
                want += sign * math.log((1 / width + s) / (len(ps) + 1))
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_guided_draws_go_where_trials_were_good(spark):
    space = L.SearchSpace({"learning_rate": (0.01, 0.3), "subsample": (0.5, 1.0)})
    past = [(i, "COMPLETE", 1 - abs(p["subsample"] - .9), {k: float(p[k]) for k in space.ranges})
            for i, p in enumerate(L.random_trials(space, 60, 1))]
    df = spark.createDataFrame(past, SCHEMA)
    a, b = L.guided_trials(space, df, 20, seed=3), L.guided_trials(space, df, 20, seed=3)
    assert a == b and len(a) == 20
    off = lambda ts: sum(abs(t["subsample"] - .9) for t in ts) / len(ts)
    assert off(a) < .5 * off(L.random_trials(space, 200, 3))
    assert all(.5 <= t["subsample"] <= 1 and .01 <= t["learning_rate"] <= .3 for t in a)


def test_pruning_rule():
    past = [[.5, .6, .7], [.4, .4, .4], [.6, .7, .6]]
    assert L.pruned_after([.45, .9, .9], past) == 1
    assert L.pruned_after([.5, .55, .9], past) == 2
    assert L.pruned_after([.5, .6, .1], past) is None  # after the last fold there is nothing to save
    assert L.pruned_after([.1, .1], []) is None


def test_pruned_trials_are_marked_and_leave_the_rest_alone(spark):
    u = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    df = spark.range(240).select("id", u.alias("a"), (u + F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000)) / 900 > 1)
                                 .cast("double").alias("label"))
    space = L.SearchSpace({"n_estimators": (1, 3), "max_depth": (1, 3)})
    args = dict(stages=(3, 3), folds=2, parallelism=2, guided=True, prune=True)
    got = [tuple(r) for r in L.staged_search(df, "label", "id", E.Layout(scaled=("a",)), space, **args).orderBy("number").collect()]
    assert len(got) == 6 and {r[2] for r in got} <= {"COMPLETE", "PRUNED"} and all(r[2] == "COMPLETE" for r in got[:3])
    again = [tuple(r) for r in L.staged_search(df, "label", "id", E.Layout(scaled=("a",)), space, **args).orderBy("number").collect()]
    assert [(r[0], r[1], r[2], r[4]) for r in got] == [(r[0], r[1], r[2], r[4]) for r in again]
