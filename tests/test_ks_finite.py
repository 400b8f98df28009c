"""The finite-n KS p-value against an independent evaluation of the exact
distribution, and its place in the drift report."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwood.functions import stats as S
from driftwood.operators import drift as D


def inside(n, d):
    """P(D_n < d) by the lattice matrix, plainly."""
    k = int(n * d) + 1
    m, h = 2 * k - 1, k - n * d
    big = np.array([[1.0 if i - j + 1 >= 0 else 0.0 for j in range(m)] for i in range(m)])
    for i in range(m):
        big[i, 0] -= h ** (i + 1)
        big[m - 1, i] -= h ** (m - i)
    big[m - 1, 0] += max(0.0, 2 * h - 1) ** m
    for i in range(m):
        for j in range(i + 1):
            big[i, j] /= math.factorial(i - j + 1)
    v = np.eye(m)[k - 1]
    for s in range(1, n + 1):
        v = big @ v * (s / n)
    return v[k - 1]


def p_values(spark, rows):
    df = spark.createDataFrame(rows, "d double, n1 long, n2 long")
    out = df.select("*", *S.ks_finite_prepare("d", "n1", "n2")).select("d", "n1", S.ks_finite_sf("d", "n1", "n2").alias("p"))
    return [r["p"] for r in out.collect()]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 37, 150, 400, 401, 700])
def test_equals_the_exact_distribution(spark, n):
    ds = sorted({min(.999, z / math.sqrt(n)) for z in np.linspace(.21, 2.4, 23)})
    got = p_values(spark, [(float(d), 2 * n, 2 * n) for d in ds])
    for d, p in zip(ds, got):
        want = 1.0 if d <= 1 / (2 * n) else 1 - inside(n, d)
        assert abs(p - want) < 1e-6, (n, d)


def test_no_size_is_out_of_reach(spark):
    huge = 4 * 10**11
    got = p_values(spark, [(z / math.sqrt(huge / 2), huge, huge) for z in (.1, .5, 1.0, 2.0, 6.0)])
    for z, p in zip((.1, .5, 1.0, 2.0, 6.0), got):
        want = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 200))
        assert abs(p - want) < 2e-6
    assert 0 < got[-1] < 1e-30  # the far tail is no rounding noise


def test_defined_cases(spark):
    assert p_values(spark, [(None, 5, 5), (0.0, 5, 5), (1.0, 9, 9), (.5, 0, 9), (.5, 1, 1), (1.0, 1, 10**9)]) == [
        None, 1.0, 0.0, None, 1.0, 0.0]


def test_report_takes_the_method(spark):
    ref = spark.range(900).select((F.col("id") * 7 % 900).cast("double").alias("x"), (F.col("id") % 3).alias("c"))
    cur = spark.range(600).select((F.col("id") * 7 % 600 * 1.55).alias("x"), (F.col("id") % 3).alias("c"))
    row = {r["feature"]: r for r in D.feature_drift_report(ref, cur, ["x"], ["c"], p_method="finite").collect()}
    assert abs(row["x"]["p_value"] - (1 - inside(360, row["x"]["metric_value"]))) < 1e-6
    assert "c" in row
    with pytest.raises(ValueError):
        D.ks_test(ref, cur, ["x"], p_method="auto")


@pytest.mark.parametrize("n, h", [(4000, 90), (20000, 250)])
def test_exact_count_at_sizes_that_were_refused(spark, n, h):
    """Equal sizes have a closed form: alternating sums of binomials."""
    from fractions import Fraction

    from driftwood.functions.stats import ks_exact_sf
    from driftwood.operators import drift as D
    whole = math.comb(2 * n, n)
    p = 2 * sum((-1) ** (k + 1) * Fraction(math.comb(2 * n, n + k * h), whole) for k in range(1, 12))
    assert ks_exact_sf(h / n, n, n) == pytest.approx(float(p), rel=1e-10)
    stat = spark.createDataFrame([("x", h / n, n, n)], "feature string, ks_stat double, n_ref long, n_cur long")
    assert D.ks_rows(stat, p_method="exact").first()["p_value"] == pytest.approx(float(p), rel=1e-10)


def test_exact_count_of_unequal_sizes_cell_by_cell():
    from driftwood.functions.stats import ks_exact_sf
    for n1, n2, d in [(1, 1, 1.0), (3, 1000, 0.5), (40, 17, 0.3), (260, 1301, 0.09), (600, 601, 0.05), (900, 900, 0.9)]:
        h, row = round(d * n1 * n2), [1] + [0] * n2
        for i in range(n1 + 1):  # whole numbers, cell by cell
            for j in range(n2 + 1):
                came = (row[j] if i or not j else 0) + (row[j - 1] if j else 0)
                row[j] = came if abs(i * n2 - j * n1) < h else 0
        p = 1 - row[n2] / math.comb(n1 + n2, n1)
        assert ks_exact_sf(d, n1, n2) == pytest.approx(p, abs=1e-12)
