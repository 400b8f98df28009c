"""The stored run table: replayed appends, atomic removals, versions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftwood.sources import run_store as S

SCHEMA = "run_id string, experiment string, start_time timestamp, score double"


def make(spark, ids, experiment="e", schema=SCHEMA):
    return spark.createDataFrame([(f"r{i}", experiment, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i / 10) for i in ids], schema)


def ids(df):
    return sorted(r["run_id"] for r in df.select("run_id").collect())


def test_replayed_append_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "runs")
    S.append(make(spark, range(5)), path, "a")
    S.append(make(spark, range(5, 8)), path, "b")
    S.append(make(spark, range(5, 8)), path, "b")
    S.append(make(spark, range(5)), path, "a")
    assert ids(S.read_runs(spark, path)) == [f"r{i}" for i in range(8)]
    S.append(make(spark, range(5, 7)), path, "b")  # a corrected batch takes its place
    assert ids(S.read_runs(spark, path)) == [f"r{i}" for i in range(7)]
    assert S.read_runs(spark, path).columns == ["run_id", "experiment", "start_time", "score"]


def test_new_columns_are_null_in_old_runs(spark, tmp_path):
    path = str(tmp_path / "runs")
    S.append(make(spark, range(2)), path, "a")
    S.append(make(spark, range(2, 4)).withColumn("note", F.lit("x")).drop("score"), path, "b")
    got = {r["run_id"]: (r["score"], r["note"]) for r in S.read_runs(spark, path).collect()}
    assert got == {"r0": (0.0, None), "r1": (0.1, None), "r2": (None, "x"), "r3": (None, "x")}


def test_removal_is_one_switch(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "runs")
    S.append(make(spark, range(6)), path, "a")
    S.append(make(spark, range(10, 13), "other"), path, "b")
    before = S.read_runs(spark, path)  # a reader that has started
    assert S.remove_recent(spark, path, "e", 4) == 2
    assert ids(before) == [*sorted(f"r{i}" for i in [*range(6), 10, 11, 12])]
    assert ids(S.read_runs(spark, path)) == ["r0", "r1", "r10", "r11", "r12"]
    assert ids(S.read_runs(spark, path, version=1)) == ids(before)
    # appends go on in the new version, and a replayed batch stays one
    S.append(make(spark, range(20, 22)), path, "c")
    S.append(make(spark, range(20, 22)), path, "c")
    assert ids(S.read_runs(spark, path)) == ["r0", "r1", "r10", "r11", "r12", "r20", "r21"]
    # a removal that fails before the switch changes nothing
    stored = spark.read.parquet(S._folder(path, 2))
    broken = stored.where(F.raise_error(F.lit("lost")).isNull())
    with pytest.raises(Exception):
        S.publish(broken, path, 2)
    assert S.versions(spark, path) == [1, 2] and len(ids(S.read_runs(spark, path))) == 7
    # who comes second doesn't overwrite
    with pytest.raises(RuntimeError):
        S.publish(stored, path, 1)
    assert S.versions(spark, path) == [1, 2]
    assert S.drop_old(spark, path, keep=1) == [1] and S.versions(spark, path) == [2]


def test_defined_cases(spark, tmp_path):
    path = str(tmp_path / "nothing")
    with pytest.raises(ValueError):
        S.read_runs(spark, path)
    with pytest.raises(ValueError):
        S.remove_recent(spark, path, "e", 1)
    with pytest.raises(ValueError):
        S.append(make(spark, [1]), path, "a/b")
    S.append(make(spark, [1, 2]), path, "a")
    S.remove_recent(spark, path, "e", 1)
    with pytest.raises(ValueError):
        S.read_runs(spark, path, version=9)
    assert S.remove_recent(spark, path, "unknown", 5) == 3 and ids(S.read_runs(spark, path)) == ["r1"]
