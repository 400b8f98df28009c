"""The binned kernel density stays within its stated error, and its work
doesn't grow with the number of values."""

import pytest
from pyspark.sql import functions as F

from driftwood.operators import profile as P


@pytest.mark.parametrize("tolerance", [1e-3, 1e-6])
def test_binned_within_the_stated_error(spark, tolerance):
    u = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(100_003)) / 100_003
    df = spark.range(4000).select((F.col("id") % 3).alias("c"), (u(1) * u(2) * 50 + F.col("id") % 3).alias("v")) \
        .unionByName(spark.createDataFrame([(0, None), (1, float("nan")), (None, 3.0)], "c long, v double"))
    exact = {(r["group"], r["point"]): r for r in P.gaussian_kde(df, "v", 40, by="c").collect()}
    binned = {(r["group"], r["point"]): r for r in P.gaussian_kde(df, "v", 40, by="c", tolerance=tolerance).collect()}
    h = {str(r["c"]): r["h"] for r in df.where("c is not null and v is not null and not isnan(v)").groupBy("c").agg(
        (F.stddev_samp("v") * F.pow(F.count("v"), F.lit(-.2))).alias("h")).collect()}
    assert exact.keys() == binned.keys() and len(exact) == 120
    worst = 0
    for k, e in exact.items():
        off = abs(e["density"] - binned[k]["density"])
        assert off < tolerance / h[k[0]]
        worst = max(worst, off * h[k[0]])
    assert 0 < worst


def test_repeated_values_and_few_rows(spark):
    df = spark.createDataFrame([(1.0,)] * 50 + [(2.0,)] * 30 + [(5.0,)], "v double")
    exact = P.gaussian_kde(df, "v", 7).orderBy("point").collect()
    binned = P.gaussian_kde(df, "v", 7, tolerance=1e-7).orderBy("point").collect()
    assert [r["density"] for r in binned] == pytest.approx([r["density"] for r in exact], abs=1e-6)
    plan = P.gaussian_kde(df, "v", 7, tolerance=1e-7)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
