"""Many logistic regressions at once against one at a time, closed forms and
Spark ML."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from driftwood.operators import newton as N


@pytest.fixture(scope="module")
def data(spark):
    u = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(10_007)) / 10_007
    df = spark.range(1500).select(
        "id", (u(1) * 4 - 2).alias("a"), (u(2) * 100).alias("b"), F.when(u(3) < .4, 1.0).otherwise(0.0).alias("flag"),
        F.lit(5.0).alias("same"), (F.col("id") % 4).cast("int").alias("fold"), u(4).alias("u"))
    z = 0.8 * F.col("a") - 0.03 * F.col("b") + F.col("flag")
    return df.withColumn("y", (F.col("u") < 1 / (1 + F.exp(-z))).cast("double")).drop("u").repartition(5).cache()


def alone(x, y, ridge):
    """Newton on one model, plainly."""
    mean, dev = x.mean(0), x.std(0)
    z = np.column_stack([np.ones(len(y)), (x - mean) / dev])
    w = np.zeros(z.shape[1])
    pen = np.r_[0, np.full(z.shape[1] - 1, ridge)]
    for _ in range(40):
        p = 1 / (1 + np.exp(-z @ w))
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pen) * len(y),
                                z.T @ (y - p) - pen * len(y) * w)
    return w, mean, dev


SETS = [["a"], ["a", "b"], ["b", "flag", "a"], ["flag"]]


def test_same_as_one_at_a_time(spark, data):
    fits = N.fit_many(data, "y", SETS, "fold", [0, 1, 2, 3], ridge=0.0)
    assert [(f.columns, f.fold) for f in fits] == [(s, k) for s in SETS for k in range(4)]
    p = data.toPandas()
    for f in fits:
        part = p[p["fold"] != f.fold]
        w, mean, dev = alone(part[f.columns].to_numpy(), part["y"].to_numpy(), 0.0)
        assert f.converged and f.steps < 15
        assert np.allclose(f.coefficients, w[1:] / dev, rtol=0, atol=1e-9)
        assert f.intercept == pytest.approx(w[0] - (w[1:] / dev * mean).sum(), abs=1e-8)


def test_scores_same_as_separate_fits_and_repeatable(spark, data):
    together = N.cv_scores(data, "y", SETS, "fold", [0, 1, 2, 3])
    assert together == N.cv_scores(data, "y", SETS, "fold", [0, 1, 2, 3])
    for s, scores in zip(SETS, together):
        one = N.cv_scores(data, "y", [s], "fold", [0, 1, 2, 3])[0]
        assert scores.keys() == one.keys() == {0, 1, 2, 3}
        assert all(abs(scores[k] - one[k]) < 1e-9 for k in one)


def test_close_to_the_library(spark, data):
    fit = N.fit_many(data, "y", [["a", "b", "flag"]], ridge=0.0)[0]
    vec = VectorAssembler(inputCols=["a", "b", "flag"], outputCol="v").transform(data)
    lib = LogisticRegression(featuresCol="v", labelCol="y", maxIter=200, tol=1e-10).fit(vec)
    assert np.allclose(fit.coefficients, lib.coefficients.toArray(), atol=1e-4)
    assert fit.intercept == pytest.approx(lib.intercept, abs=1e-4)


def test_binary_column_has_the_closed_form(spark, data):
    fit = N.fit_many(data, "y", [["flag"]], ridge=0.0)[0]
    rate = {r["flag"]: r["r"] for r in data.groupBy("flag").agg(F.avg("y").alias("r")).collect()}
    logit = lambda p: math.log(p / (1 - p))
    assert fit.intercept == pytest.approx(logit(rate[0.0]), abs=1e-9)
    assert fit.coefficients[0] == pytest.approx(logit(rate[1.0]) - logit(rate[0.0]), abs=1e-9)


def test_awkward_tables(spark, data):
    # separable, constant and repeated columns end with finite weights
    odd = data.withColumn("sep", F.col("y") * 3 - 1).withColumn("again", F.col("a"))
    fits = N.fit_many(odd, "y", [["sep"], ["same", "a"], ["a", "again"]])
    assert all(np.isfinite(f.weights).all() for f in fits) and all(f.converged for f in fits[1:])
    # missing values count as the mean, rows without label or fold are left out
    holes = data.withColumn("a", F.when(F.col("id") % 10 == 0, float("nan")).otherwise(F.col("a")))
    mean = holes.where("not isnan(a)").agg(F.avg("a")).first()[0]
    full = holes.withColumn("a", F.when(F.isnan("a"), mean).otherwise(F.col("a")))
    extra = holes.unionByName(data.limit(20).withColumn("y", F.lit(None).cast("double")))
    x, z = N.fit_many(extra, "y", [["a"]], ridge=0.0)[0], N.fit_many(full, "y", [["a"]], ridge=0.0)[0]
    dev = [d.agg(F.stddev_pop(F.when(~F.isnan("a"), F.col("a")))).first()[0] for d in (holes, full)]
    assert dev[0] > dev[1] and x.coefficients[0] == pytest.approx(z.coefficients[0], abs=1e-9)
    assert N.fit_many(data.where("false"), "y", [["a"]])[0].converged is False
    one = N.cv_scores(data.withColumn("y", F.when(F.col("fold") == 2, 0.0).otherwise(F.col("y"))), "y", [["a"]], "fold", [0, 1, 2, 3])
    assert one[0].keys() == {0, 1, 3}  # no positives, no score
