"""Stored summaries: the report of two summaries is that of the tables, parts
merge, and sketched features stay within their stated error."""

import pytest
from pyspark.sql import functions as F

from driftwood.operators import drift as D
from driftwood.operators import summaries as S


@pytest.fixture(scope="module")
def tables(spark):
    def make(n, seed, shift):
        r = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(100_003)) / 100_003
        return spark.range(n).select(
            (F.col("id") % 5).alias("day"), F.when(F.col("id") % 11 > 0, r * r + shift).alias("x"),
            F.when(F.col("id") % 7 > 0, F.floor(r * 9)).otherwise(float("nan")).alias("y"),
            F.when(r < .3 + shift, "a").when(r < .8, "b").when(r < .95, "c").alias("c"),
            (F.col("id") % 2).cast("double").alias("d"))
    return make(6000, 1, 0.0), make(4000, 2, 0.02)


def same(a, b):
    key = lambda r: r["feature"]
    a, b = sorted(a.collect(), key=key), sorted(b.collect(), key=key)
    assert [r["feature"] for r in a] == [r["feature"] for r in b]
    for x, y in zip(a, b):
        assert x["type"] == y["type"] and x["drift_detected"] == y["drift_detected"]
        assert x["metric_value"] == pytest.approx(y["metric_value"], abs=1e-12)
        assert x["p_value"] == pytest.approx(y["p_value"], abs=1e-12)


@pytest.mark.parametrize("p_method", ["asymptotic", "finite"])
def test_report_of_summaries_is_that_of_tables(spark, tables, tmp_path, p_method):
    ref, cur = tables
    num, cat = ["x", "y", "nowhere"], ["c", "d"]
    want = D.feature_drift_report(ref, cur, num, cat, p_method=p_method)
    a, b = S.merge(S.summarise(ref, num, cat)), S.merge(S.summarise(cur, num, cat))
    same(S.report(a, b, p_method=p_method), want)
    # parts, stored by day, merged again; a replayed day adds nothing
    path = str(tmp_path / p_method)
    stored = S.summarise(ref, num, cat, by=["day"])
    S.write_summary(stored, path, ["day"])
    S.write_summary(stored.where("day = 3"), path, ["day"])
    same(S.report(S.read_summary(spark, path), b, p_method=p_method), want)
    some = D.feature_drift_report(ref.where("day < 2"), cur, num, cat, p_method=p_method)
    same(S.report(S.read_summary(spark, path, "day < 2"), b, p_method=p_method), some)


@pytest.mark.parametrize("sketched", ["both", "one", "days"])
def test_sketched_features_stay_within_the_stated_error(spark, tables, sketched):
    ref, cur = tables
    k = 400
    exact = {r["feature"]: r for r in D.ks_statistics(ref, cur, ["x", "y"]).collect()}
    a = S.summarise(ref, ["x", "y"], [], exact_values=100, k=k)
    b = S.summarise(cur, ["x", "y"], [], exact_values=100 if sketched == "both" else 10**6, k=k)
    if sketched == "days":  # exact on some days, sketched on others
        a = S.merge(S.summarise(ref.where("day < 3"), ["x", "y"], [], by=["day"], exact_values=100, k=k),
                    S.summarise(ref.where("day >= 3"), ["x", "y"], [], by=["day"]))
    kinds = {(r["feature"], r["kind"]) for r in a.select("feature", "kind").distinct().collect()}
    assert ("x", "sketch") in kinds and ("y", "value") in kinds and (("x", "value") in kinds) == (sketched == "days")
    got = {r["feature"]: r for r in S.ks_from_summaries(S.merge(a), S.merge(b), k=k).collect()}
    for f in ("x", "y"):
        assert (got[f]["n_ref"], got[f]["n_cur"]) == (exact[f]["n_ref"], exact[f]["n_cur"])
        assert abs(got[f]["ks_stat"] - exact[f]["ks_stat"]) <= got[f]["ks_error"] + 1e-12
    assert got["y"]["ks_error"] == 0 < got["x"]["ks_error"] < .03
    assert a.where("feature = 'x' and kind = 'sketch'").select(F.max(F.length("sketch"))).first()[0] < 40_000


def test_defined_cases(spark, tables):
    ref, _ = tables
    with pytest.raises(ValueError):
        S.summarise(ref, ["nowhere"], [])
    a = S.merge(S.summarise(ref, ["x"], ["c"]))
    empty = S.merge(S.summarise(ref.where("false"), ["x"], ["c"]))
    assert empty.count() == 0 and S.report(a, empty).collect() == []
    only = S.merge(S.summarise(ref, ["y"], ["c"]))  # features that one side lacks are left out
    assert [r["feature"] for r in S.report(a, only).collect()] == ["c"]
    ints = S.merge(S.summarise(ref.select(F.col("d").cast("int").alias("d")), [], ["d"]))
    assert S.report(ints, S.merge(S.summarise(ref, [], ["d"]))).first()["metric_value"] == pytest.approx(0, abs=1e-12)
