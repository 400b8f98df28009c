"""Kendall's tau-b against pair counting."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwood.operators import kendall as K
from driftwood.operators import profile as P


def tau(x, y):
    s = n1 = n2 = 0
    n0 = len(x) * (len(x) - 1) // 2
    for i in range(len(x)):
        for j in range(i):
            a, b = (x[i] > x[j]) - (x[i] < x[j]), (y[i] > y[j]) - (y[i] < y[j])
            s, n1, n2 = s + a * b, n1 + (a == 0), n2 + (b == 0)
    return s / math.sqrt((n0 - n1) * (n0 - n2)) if n0 > n1 and n0 > n2 else None


def test_agreement_same_as_pairs():
    rnd = np.random.default_rng(1)
    for size in (1, 2, 3, 40, 90):
        a, b, n = rnd.integers(0, 9, size), rnd.integers(0, 30, size), rnd.integers(1, 5, size)
        want = sum(int(np.sign(a[i] - a[j]) * np.sign(b[i] - b[j]) * n[i] * n[j]) for i in range(size) for j in range(i))
        assert K.agreement(a, b, n) == want
    assert K.agreement(np.zeros(0), np.zeros(0), np.zeros(0, int)) == 0
    big = np.full(2, 4_000_000_000)  # products beyond 64 bits are exact
    assert K.agreement(np.array([1, 2]), np.array([3, 4]), big) == 16 * 10**18


@pytest.mark.parametrize("buckets", [None, 1, 2, 13, 200])
def test_tau_same_as_pairs(spark, buckets):
    rnd = random.Random(2)
    rows = []
    for i in range(300):
        x = rnd.choice([1.5, 1.5, 1.5, rnd.gauss(0, 2), -0.0, 0.0])  # hot values and a signed zero
        rows.append((x, rnd.choice([rnd.gauss(x, 1), float(rnd.randint(0, 3)), 2.0]), float(rnd.randint(0, 1)), 7.0))
    holes = [(None, 1.0, 1.0, 7.0), (float("nan"), 2.0, 0.0, 7.0)]
    df = spark.createDataFrame(rows + holes, "x double, y double, z double, same double").repartition(4)
    got = {(r.col_a, r.col_b): r["corr"] for r in K.kendall(df, [("x", "y"), ("y", "z"), ("x", "same")], buckets).collect()}
    every = rows + holes
    assert got["x", "y"] == pytest.approx(tau([r[0] for r in rows], [r[1] for r in rows]), abs=1e-12)
    assert got["y", "z"] == pytest.approx(tau([r[1] for r in every], [r[2] for r in every]), abs=1e-12)
    assert got["x", "same"] is None


def test_matrix_and_empty(spark):
    df = spark.range(50).select(F.col("id").alias("a"), (-F.col("id")).alias("b"), (F.col("id") % 7).alias("c"))
    got = {(r.col_a, r.col_b): r["corr"] for r in P.correlation_matrix(df, ["a", "b", "c"], "kendall").collect()}
    assert got["b", "a"] == pytest.approx(-1.0) and set(got) == {("b", "a"), ("c", "a"), ("c", "b")}
    assert got["c", "a"] == pytest.approx(-got["c", "b"])
    assert K.kendall(df.where("false"), [("a", "b")]).first()["corr"] is None
