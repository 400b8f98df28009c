"""Sources and sinks round trips (scratch folders from pytest's tmp_path)."""

import json

from pyspark.sql import functions as F

from driftwood.operators import drift as D
from driftwood.operators.splits import stratified_split
from driftwood.sources import files as S
from driftwood.sources.tables import table

from conftest import SF_SMALL


def test_csv_with_schema(spark, tmp_path):
    p = tmp_path / "churn.csv"
    header = ",".join(f.name for f in S.CHURN_SCHEMA.fields)
    p.write_text(header + "\n1,15634602,Hargrave,619,France,Female,42,2,0.0,1,1,1,101348.88,1,1,2,DIAMOND,464\n")
    df = S.read_csv(spark, str(p))
    r = df.first()
    assert r["CreditScore"] == 619 and r["Card Type"] == "DIAMOND" and r["Point Earned"] == 464
    S.check_target(df, "Exited")


def test_split_tables_rejoin_by_key(spark, tmp_path):
    cust = table(spark, SF_SMALL, "customer", ["c_custkey", "c_acctbal", "c_mktsegment"]) \
        .withColumn("y", (F.col("c_acctbal") > 5000).cast("int"))
    s = stratified_split(cust, "y", "c_custkey", 0.2, 0.2)
    out = str(tmp_path / "splits")
    S.write_features_and_target(s, out, "c_custkey", "y", fmt="csv")
    feats = S.read_split(spark, f"{out}/features", "test", "csv")
    tgt = S.read_split(spark, f"{out}/target", "test", "csv").drop("split")
    joined = S.join_features_target(feats, tgt, "c_custkey")
    assert joined.count() == s.where("split = 'test'").count()
    S.write_splits(s, str(tmp_path / "one"))
    assert S.read_split(spark, str(tmp_path / "one"), "val").count() == s.where("split = 'val'").count()


def test_registry_round_trip(spark, tmp_path):
    reg = {"selected_features": ["Age_x_IsActive"], "nomod_columns": ["HasCrCard"],
           "dummyfy_columns": ["Gender"], "norm_std_columns": ["Age", "Balance"]}
    S.write_registry(spark, reg, str(tmp_path / "reg"))
    assert S.registry_dict(S.read_registry(spark, str(tmp_path / "reg"))) == reg
    p = tmp_path / "registry.json"
    p.write_text(json.dumps(reg, indent=4))
    assert S.registry_dict(S.read_registry(spark, str(p))) == reg


def test_report_document(spark):
    a = spark.createDataFrame([(1.0, "x"), (2.0, "y")], "v double, c string")
    rep = D.feature_drift_report(a, a, ["v"], ["c"])
    doc = S.parse_document(S.report_document(rep).first()["document"])
    assert doc["drift_detected"] is False and len(doc["report"]) == 2
    assert S.report_records(rep).count() == 2


def test_ship_package_adds_zip_once(spark):
    from driftwood import session as S
    before = set(S._SHIPPED)
    S.ship_package(spark)
    S.ship_package(spark)
    assert spark.sparkContext.applicationId in S._SHIPPED
    assert len(S._SHIPPED - before) <= 1
    # a Python worker can import the package
    rows = spark.range(2).rdd.map(lambda _: __import__("driftwood.functions.stats").__name__).collect()
    assert rows == ["driftwood", "driftwood"]
