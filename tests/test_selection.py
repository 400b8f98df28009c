"""Quantiles by radix refinement against numpy and the bucketed version."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwood.operators import cumulative as C
from driftwood.operators import selection as S

PROBS = [0.0, 0.01, 0.1, 0.25, 1 / 3, 0.5, 0.75, 0.999, 1.0]


def columns(rnd):
    one = 1.0
    ulps = [one]
    for _ in range(60):
        ulps.append(math.nextafter(ulps[-1], 2))
    return {
        "uniform": [rnd.random() for _ in range(900)],
        "wide": [rnd.choice([-1, 1]) * 10 ** rnd.uniform(-300, 300) for _ in range(700)],
        "ulps": [rnd.choice(ulps) for _ in range(800)],
        "powers": [2.0 ** rnd.randint(-1074, 1023) for _ in range(300)] + [-2.0 ** i for i in range(50)],
        "hot": [7.25] * 1200 + [rnd.gauss(7.25, 1e-9) for _ in range(500)],
        "ends": [math.inf, math.inf, -math.inf, 0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308],
        "one": [3.0],
        "gaps": [None, math.nan, 1.0, None, 2.0, math.nan],
        "none": [None, math.nan],
    }


@pytest.mark.parametrize("few, small", [(S.FEW, S.SMALL), (0, S.SMALL), (30, 5), (0, 0)])
def test_all_columns_at_once_same_as_numpy(spark, monkeypatch, few, small):
    monkeypatch.setattr(S, "SMALL", small)
    cols = columns(random.Random(1))
    df = spark.createDataFrame([(c, v) for c, vs in cols.items() for v in vs] + [(None, 1.5), (None, 2.5)],
                               "c string, v double").repartition(5)
    got = {r["c"]: r for r in S.exact_quantiles(df, "v", PROBS, by=["c"], few=few).collect()}
    assert set(got) == {*cols, None} - {"none"}
    for c, vs in [*cols.items(), (None, [1.5, 2.5])]:
        vs = np.sort([v + 0.0 for v in vs if v is not None and not math.isnan(v)])
        for i, p in enumerate(PROBS):
            if not len(vs):
                continue
            h = (len(vs) - 1) * p
            lo, hi = vs[math.floor(h)], vs[math.ceil(h)]
            want = lo if h == math.floor(h) else lo + (h - math.floor(h)) * (hi - lo)
            assert got[c][f"q_{i}"] == want or math.isnan(want) and math.isnan(got[c][f"q_{i}"]), (c, p)


def test_several_keys_and_none(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("a"), (F.col("id") % 2 == 0).alias("b"),
                                  (F.xxhash64("id") % 1000 / 7).alias("v"))
    a = S.exact_quantiles(df, "v", [.1, .5], by=["a", "b"], few=10).orderBy("a", "b").collect()
    b = C.exact_quantiles(df, "v", [.1, .5], by=["a", "b"]).orderBy("a", "b").collect()
    assert a == b and len(a) == 14
    assert S.exact_quantiles(df, "v", [.1, .5]).collect() == C.exact_quantiles(df, "v", [.1, .5]).collect()
    assert S.exact_quantiles(df.where("false"), "v", [.5], by=["a"]).collect() == []


def test_first_digit_is_monotone(spark):
    xs = sorted({v + 0.0 for vs in columns(random.Random(2)).values() for v in vs if v is not None and not math.isnan(v)})
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    digits = [r["d"] for r in df.select("x", S.first_digit(F.col("x")).alias("d")).orderBy("x").collect()]
    assert digits == sorted(digits)


def test_no_exchange_carries_values(spark):
    """Values leave their task only as the extremes of a digit."""
    df = spark.range(200_000).select((F.xxhash64("id") / 1e9).alias("v"))
    hist = S._histogram(df.select(F.lit(0).alias("g"), F.col("v").alias("_dw_v")).withColumn(
        "_dw_digit", S.first_digit(F.col("_dw_v"))), ["g"])
    assert hist.count() < 20 * S.DIGITS_0 * 2
    plan = hist._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and plan.count("Exchange hashpartitioning") == 1
