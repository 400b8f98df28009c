"""Round trips through files and invariants of fitted or random operators,
each over its whole table and with an exact SQL twin.  Files go below the
shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftwood.functions import features as FE
from driftwood.functions import names as N
from driftwood.operators import drift as D
from driftwood.operators import explain as X
from driftwood.operators import metrics as M
from driftwood.operators import models as L
from driftwood.operators import preprocess as E
from driftwood.operators import runs as R
from driftwood.operators import splits as K
from driftwood.plans import q_models
from driftwood.plans.catalog import query
from driftwood.plans.common import SCORED_SQL, event_halves, rounded, scored_documents
from driftwood.plans.customer360 import C360_CATEGORIES, customer360, customer360_sql
from driftwood.plans.q_features import FEATURE_SQL
from driftwood.plans.q_preprocess import REGISTRY
from driftwood.plans.runs_table import runs as runs_table
from driftwood.plans.runs_table import runs_sql
from driftwood.session import ensure_checkpoint_dir
from driftwood.sources import files as S

C360 = "WITH " + customer360_sql()
KEY, LABEL = "CustomerId", "Exited"


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _split(spark, sf_dir):
    return K.stratified_split(customer360(spark, sf_dir), LABEL, KEY, test_size=0.2, val_size=0.2, seed=43)


@query("csv_round_trip", oracle=f"""{C360}
SELECT Geography, count(*) AS n, sum(CreditScore)::BIGINT AS credit, round(sum(Balance), 4) AS balance
FROM customer360 GROUP BY Geography""")
def csv_round_trip(spark, sf_dir):
    """A CSV with header written and read with an explicit schema."""
    path = _folder(spark, "csv")
    src = customer360(spark, sf_dir).select("CustomerId", "Geography", "CreditScore", "Balance")
    src.write.option("header", True).csv(path)
    back = S.read_csv(spark, path, src.schema)
    return back.groupBy("Geography").agg(F.count("*").alias("n"), F.sum("CreditScore").alias("credit"),
                                         F.round(F.sum("Balance"), 4).alias("balance"))


@query("split_tables_rejoined", oracle=f"""{C360}
SELECT {LABEL}, count(*) AS n, round(sum(EstimatedSalary), 2) AS salary FROM customer360 GROUP BY {LABEL}""")
def split_tables_rejoined(spark, sf_dir):
    """Features and target of each split written apart as CSV,
    read split by split and joined again by key."""
    path = _folder(spark, "splits")
    S.write_features_and_target(_split(spark, sf_dir).select(KEY, "EstimatedSalary", LABEL, "split"),
                                path, KEY, LABEL, fmt="csv")
    out = None
    for s in ("train", "val", "test"):
        one = S.join_features_target(S.read_split(spark, f"{path}/features", s, "csv").drop("split"),
                                     S.read_split(spark, f"{path}/target", s, "csv").drop("split"), KEY)
        out = one if out is None else out.unionByName(one)
    return out.groupBy(F.col(LABEL).cast("int").alias(LABEL)).agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("EstimatedSalary").cast("double")), 2).alias("salary"))


def _column_sums(df):
    """A row per column of ``df``: rows, nulls, and the sum of its numbers or of
    its texts' lengths, so that every value of every column counts."""
    def total(f):
        c = F.col(f"`{f.name}`")
        return F.sum(F.length(c) if f.dataType.typeName() == "string" else c.cast("double"))
    cells = [F.struct(F.lit(f.name).alias("feature"), F.count(F.lit(1)).alias("n"),
                      F.count_if(F.col(f"`{f.name}`").isNull()).alias("nulls"),
                      F.round(total(f).cast("double"), 3).alias("total")) for f in df.schema.fields]
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def _sums_sql(source: str, columns: dict[str, str], texts: tuple = ()) -> str:
    """The same rows; ``columns`` are names and SQL expressions."""
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS feature, count(*) AS n, count(*) - count({x}) AS nulls, "
        f"round(CAST(sum({f'length({x})' if name in texts else f'CAST({x} AS DOUBLE)'}) AS DOUBLE), 3) AS total FROM {source}"
        for name, x in columns.items())


@query("registry_applied_from_file", oracle=C360 + "\n" + _sums_sql("customer360", {
    **{name: FEATURE_SQL[name] for name in (
        "Age_x_IsActive", "Balance_plus_Salary", "Balance_x_Tenure", "Products_per_Tenure", "Num_Of_Products_1",
        "Num_Of_Products_2", "is_germany")},
    "HasCrCard": "HasCrCard", "Card Type": '"Card Type"', "Gender": "Gender", "Age": "Age", "Balance": "Balance",
    "CreditScore": "CreditScore"}, ("Card Type", "Gender")))
def registry_applied_from_file(spark, sf_dir):
    """The registry written as JSON, read back, and used as a layout: the
    sums of every column that it names."""
    path = _folder(spark, "registry")
    S.write_registry(spark, REGISTRY, path)
    layout = E.layout_from_registry(S.registry_dict(S.read_registry(spark, path)))
    made = FE.add_features(customer360(spark, sf_dir), FE.required_features(layout.columns),
                           categories=C360_CATEGORIES)
    return _column_sums(made.select(*[F.col(f"`{c}`") for c in layout.columns]))


@query("target_and_features_apart", oracle=C360 + "\n" + _sums_sql("customer360", {
    "Surname": "Surname", "CreditScore": "CreditScore", "Geography": "Geography", "Gender": "Gender", "Age": "Age",
    "Tenure": "Tenure", "Balance": "Balance", "NumOfProducts": "NumOfProducts", "HasCrCard": "HasCrCard",
    "IsActiveMember": "IsActiveMember", "EstimatedSalary": "EstimatedSalary", "Card Type": '"Card Type"',
    LABEL: LABEL}, ("Surname", "Geography", "Gender", "Card Type")))
def target_and_features_apart(spark, sf_dir):
    """The target dropped from and selected beside the features, for
    all splits together: the sums of every column on its side."""
    parts = list(K.split_frames(_split(spark, sf_dir).drop(KEY), LABEL).values())
    y, x = parts[0][1], parts[0][0]
    for feats, target in parts[1:]:
        x, y = x.unionByName(feats), y.unionByName(target)
    return _column_sums(x).unionByName(_column_sums(y))


@query("columns_by_prefix", oracle=C360 + "\n" + _sums_sql("customer360", {
    "num__Age": "Age", "num__Balance": "Balance", "num__CreditScore": "CreditScore", "cat__Gender": "Gender",
    "cat__Geography": "Geography"}, ("cat__Gender", "cat__Geography")))
def columns_by_prefix(spark, sf_dir):
    """Columns chosen by their transformer prefix, and their sums."""
    c = customer360(spark, sf_dir)
    wide = c.select(*[F.col(x).alias(f"num__{x}") for x in ("Age", "Balance", "CreditScore")],
                    *[F.col(x).alias(f"cat__{x}") for x in ("Gender", "Geography")])
    return _column_sums(N.select_prefix(wide, "num__")).unionByName(_column_sums(N.select_prefix(wide, "cat__")))


@query("threshold_labels", oracle=f"""WITH {SCORED_SQL}
SELECT CAST(score >= 0.7 AS INTEGER) AS prediction, count(*) AS n FROM scored GROUP BY 1""")
def threshold_labels(spark, sf_dir):
    """P11."""
    scored = scored_documents(spark, sf_dir).drop("prediction")
    return M.threshold_label(scored, "score", 0.7).groupBy("prediction").agg(F.count("*").alias("n"))


@query("registry_from_output_names", oracle=C360 + "\nSELECT 'norm_std_columns' AS list, * FROM ("
       + _sums_sql("customer360", {"Age": "Age", "Balance": "Balance"}) + ")\nUNION ALL\n"
       "SELECT 'dummyfy_columns', * FROM (" + _sums_sql("customer360", {"Card Type": '"Card Type"', "Gender": "Gender"},
                                                        ("Card Type", "Gender")) + ")")
def registry_from_output_names(spark, sf_dir):
    """Outputs of a fitted preprocessor back to registry lists, and the sums
    of the columns that the lists name."""
    c = customer360(spark, sf_dir)
    fitted = E.fit(c, E.Layout(one_hot=("Card Type", "Gender"), scaled=("Age", "Balance")))
    names = spark.createDataFrame([(x,) for x in fitted.output_names()], "name string")
    lists = E.registry_from_outputs_df(names, "name", [], ["Card Type", "Gender"], ["Age", "Balance"]).first()
    parts = [_column_sums(c.select(*[F.col(f"`{x}`") for x in lists[name]])).select(F.lit(name).alias("list"), "*")
             for name in ("norm_std_columns", "dummyfy_columns")]
    return parts[0].unionByName(parts[1])


@query("user_feature", oracle=f"""{C360}
SELECT round(avg(Balance / (EstimatedSalary + 1)), 6) AS mean_ratio,
       count(Balance / (EstimatedSalary + 1)) AS n FROM customer360""")
def user_feature(spark, sf_dir):
    """A feature registered by the user, derived beside the fixed ones."""
    FE.register_feature("balance_to_salary", FE.CONTINUOUS, ("Balance", "EstimatedSalary"),
                        lambda b, s: F.col(b) / (F.col(s) + 1))
    try:
        made = FE.add_features(customer360(spark, sf_dir), ["balance_to_salary"])
    finally:
        FE.unregister_feature("balance_to_salary")
    return rounded(made.agg(F.avg("balance_to_salary").alias("mean_ratio"),
                            F.count("balance_to_salary").alias("n")))


@query("drift_document", oracle="""
SELECT false AS parsed_differs, 2::BIGINT AS n_records, (SELECT count(*) FROM events) AS n_events""")
def drift_document(spark, sf_dir):
    """S7, JSON: the report as one document, parsed again and compared."""
    ref, cur = event_halves(spark, sf_dir)
    report = D.feature_drift_report(ref, cur, ["value"], ["event_type"])
    kind = report.schema.simpleString()
    doc = S.report_document(report).select(F.from_json(
        "document", f"struct<drift_detected:boolean,report:array<{kind}>>").alias("d"))
    flag = D.any_drift(report).select("drift_detected").scalar()
    n = ref.unionByName(cur).select(F.count("*")).scalar()
    return doc.select((F.col("d.drift_detected") != flag).alias("parsed_differs"),
                      F.size("d.report").cast("long").alias("n_records"), n.alias("n_events"))


@query("hash_split_is_a_partition", oracle=f"""{C360}
SELECT count(*) AS n, count(DISTINCT {KEY}) AS n_keys, true AS near_share FROM customer360""")
def hash_split_is_a_partition(spark, sf_dir):
    """K1: every row in exactly one part, the share within five standard
    deviations."""
    s = K.hash_split(customer360(spark, sf_dir), KEY, test_size=0.2, seed=42)
    n, test = F.count("*"), F.count_if(F.col("split") == "test")
    return s.agg(n.alias("n"), F.count_distinct(KEY).alias("n_keys"),
                 (F.abs(test - 0.2 * n) <= 5 * F.sqrt(0.16 * n)).alias("near_share"))


@query("random_split_is_a_partition", oracle=f"""{C360}
SELECT count(*) AS n, count(DISTINCT {KEY}) AS n_keys, true AS near_share FROM customer360""")
def random_split_is_a_partition(spark, sf_dir):
    """K1, randomSplit."""
    s = K.random_split(customer360(spark, sf_dir), test_size=0.2, seed=42)
    n, test = F.count("*"), F.count_if(F.col("split") == "test")
    return s.agg(n.alias("n"), F.count_distinct(KEY).alias("n_keys"),
                 (F.abs(test - 0.2 * n) <= 5 * F.sqrt(0.16 * n)).alias("near_share"))


@query("predictions_are_consistent", oracle=f"""{C360}
SELECT count(*) AS n, count(DISTINCT {KEY}) AS n_keys, 0::BIGINT AS bad FROM customer360""")
def predictions_are_consistent(spark, sf_dir):
    """A row per key, probabilities in [0, 1], labels on their side."""
    p = F.col("churn_probability")
    bad = p.isNull() | (p < 0) | (p > 1) | ((F.col("prediction") == 1) & (p < 0.5)) \
        | ((F.col("prediction") == 0) & (p > 0.5))
    return L.batch_predict(q_models._fitted(spark, sf_dir), customer360(spark, sf_dir), KEY).agg(
        F.count("*").alias("n"), F.count_distinct(KEY).alias("n_keys"), F.count_if(bad).alias("bad"))


@query("rounded_probabilities", oracle=f"""{C360},
r AS (SELECT HasCrCard, avg({LABEL}) AS p, count(*) AS n FROM customer360 GROUP BY HasCrCard)
SELECT round(p, 4) AS churn_probability, CAST(p > 0.5 AS INTEGER) AS prediction, sum(n)::BIGINT AS n FROM r GROUP BY ALL""")
def rounded_probabilities(spark, sf_dir):
    """A logistic regression of one yes/no column predicts each
    value's rate, to four places."""
    c = customer360(spark, sf_dir).withColumn(LABEL, F.col(LABEL).cast("double"))
    pipe = L.build_pipeline(E.Layout(passthrough=("HasCrCard",)), L.classifier("logistic_regression", label=LABEL))
    return L.batch_predict(pipe.fit(c), c, KEY).groupBy("churn_probability", "prediction").agg(F.count("*").alias("n"))


@query("attributions_add_up", oracle=f"""{C360}
SELECT count(*) AS n_rows, 0::BIGINT AS bad FROM customer360""")
def attributions_add_up(spark, sf_dir):
    """Base value plus attributions is every row's margin."""
    per = q_models._shap(spark, sf_dir).groupBy(KEY).agg(
        (F.first("base_value") + F.sum("shap") - F.first("margin")).alias("gap"))
    return per.agg(F.count("*").alias("n_rows"), F.count_if(F.abs("gap") > 1e-6).alias("bad"))


@query("importances_sum_to_one", oracle=f"""{C360}
SELECT 1.0::DOUBLE AS total, true AS ends_at_one, min(1)::BIGINT AS models FROM customer360""")
def importances_sum_to_one(spark, sf_dir):
    """L11, W1, W2."""
    imp = L.feature_importance(q_models._fitted(spark, sf_dir))
    cum = next(c for c in imp.columns if c.startswith("cum"))
    return imp.agg(F.round(F.sum("importance"), 6).alias("total"),
                   (F.abs(F.max(cum) - 1.0) < 1e-6).alias("ends_at_one"), F.lit(1).cast("long").alias("models"))


@query("best_run_by_three_metrics", oracle=f"""WITH {runs_sql()}
SELECT run_id, m_pr_auc_cv AS pr_auc_cv, m_f1_score AS f1_score, m_recall AS recall
FROM runs WHERE experiment = (SELECT min(experiment) FROM runs)
ORDER BY pr_auc_cv DESC NULLS LAST, f1_score DESC NULLS LAST, recall DESC NULLS LAST, run_id LIMIT 1""")
def best_run_by_three_metrics(spark, sf_dir):
    """The best run by three keys in turn."""
    runs = runs_table(spark, sf_dir)
    first = runs.agg(F.min("experiment")).first()[0]
    return R.best_run(runs, first, ["pr_auc_cv", "f1_score", "recall"]) \
        .select("run_id", "pr_auc_cv", "f1_score", "recall")
