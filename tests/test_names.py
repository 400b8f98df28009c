"""Projection and naming helpers (P1-P5, P9, P10), split frames, sweep."""

import pytest
from pyspark.sql import functions as F

from driftwood.functions import names as N
from driftwood.operators import splits as K


def test_prefix_and_tolerant_projection(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "`cat__a_x` double, `num__b` double, `pass__c` double")
    assert N.select_prefix(df, "num__").columns == ["num__b"]
    assert N.select_existing(df, ["pass__c", "missing", "num__b"]).columns == ["pass__c", "num__b"]
    assert N.strip_prefixes(df).columns == ["a_x", "b", "c"]
    assert N.clean_name("cat__Card Type_GOLD") == "Card Type_GOLD"
    with pytest.raises(ValueError):
        N.require_columns(df, ["Exited"])


def test_map_prefix_and_clean_name_col(spark):
    df = spark.createDataFrame([({"params_a": 1.0, "other": 2.0}, "num__Age")],
                               "m map<string,double>, n string")
    r = df.select(N.map_prefix(F.col("m"), "params_").alias("p"), N.clean_name_col(F.col("n")).alias("c")).first()
    assert r["p"] == {"params_a": 1.0} and r["c"] == "Age"


def test_float32_cast(spark):
    df = spark.createDataFrame([(1, True, "2.5", "abc")], "i int, b boolean, s string, t string")
    out = N.to_float32(df)
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["float"] * 4
    assert list(out.first()) == [1.0, 1.0, 2.5, None]


def test_split_frames(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(50)], "k long, y int")
    s = K.stratified_split(df, "y", "k", 0.2, 0.2)
    frames = K.split_frames(s, "y")
    x_train, y_train = frames["train"]
    assert "y" not in x_train.columns and y_train.columns == ["y"]
    assert x_train.count() == y_train.count()


def test_selection_sweep(spark):
    from driftwood.operators import models as L
    from driftwood.operators import preprocess as E
    rows = [(i, float(i % 11), float((i * 7) % 13), float(i % 2)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label double")
    sweep = L.selection_sweep(df, "label", "id", E.Layout(scaled=("a", "b")),
                              ["logistic_regression"], [1], folds=2)
    rows = sweep.collect()
    assert {(r["direction"], r["n_features"]) for r in rows} == {("Forward", 1), ("Backward", 1)}
    assert L.best_selection(sweep).count() == 1
