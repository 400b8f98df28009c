"""Derived-feature queries on the customer360 binding (F1-F32, P-group)."""

from __future__ import annotations


from driftwood.functions.features import add_features, fixed_features, required_features
from driftwood.operators.profile import rate_by_category
from driftwood.plans.catalog import query
from driftwood.plans.common import rounded
from driftwood.plans.customer360 import C360_CATEGORIES, customer360, customer360_sql

C360 = "WITH " + customer360_sql()

# Oracle twins of the feature formulas, with the binding's category literals.
FEATURE_SQL = {
    "is_silver": f"coalesce(\"Card Type\" = '{C360_CATEGORIES['is_silver']}', false)",
    "is_germany": f"coalesce(Geography = '{C360_CATEGORIES['is_germany']}', false)",
    "is_spain": f"coalesce(Geography = '{C360_CATEGORIES['is_spain']}', false)",
    "is_france": f"coalesce(Geography = '{C360_CATEGORIES['is_france']}', false)",
    "no_balance": "coalesce(Balance < 2500, false)",
    "middle_age": "coalesce(Age > 25 AND Age < 45, false)",
    "Num_Of_Products_1": "coalesce(NumOfProducts = 1, false)",
    "Num_Of_Products_2": "coalesce(NumOfProducts = 2, false)",
    "Num_Of_Products_3": "coalesce(NumOfProducts = 3, false)",
    "Num_Of_Products_4": "coalesce(NumOfProducts = 4, false)",
    "Age_x_IsActive": "CAST(Age AS DOUBLE) * IsActiveMember",
    "Balance_x_Tenure": "Balance * CAST(Tenure AS DOUBLE)",
    "CreditScore_x_Age": "CAST(CreditScore AS DOUBLE) * Age",
    "Balance_to_Salary": "Balance / (EstimatedSalary + 1)",
    "Balance_per_Product": "Balance / (CAST(NumOfProducts AS DOUBLE) + 1)",
    "Salary_per_Product": "EstimatedSalary / (CAST(NumOfProducts AS DOUBLE) + 1)",
    "CreditScore_per_Age": "CAST(CreditScore AS DOUBLE) / (CAST(Age AS DOUBLE) + 1)",
    "Tenure_per_Age": "CAST(Tenure AS DOUBLE) / (CAST(Age AS DOUBLE) + 1)",
    "Inactive_x_Balance": "(1 - CAST(IsActiveMember AS DOUBLE)) * Balance",
    "Inactive_x_Age": "(1 - CAST(IsActiveMember AS DOUBLE)) * Age",
    "Products_x_Active": "CAST(NumOfProducts AS DOUBLE) * IsActiveMember",
    "Balance_plus_Salary": "Balance + EstimatedSalary",
    "WealthScore": "0.6 * Balance + 0.4 * EstimatedSalary",
    "LogBalance": "CASE WHEN Balance > -1 THEN ln(1 + Balance) END",
    "LogAge": "CASE WHEN Age > -1 THEN ln(1 + CAST(Age AS DOUBLE)) END",
    "Age2": "CAST(Age AS DOUBLE) * Age",
    "Balance2": "Balance * Balance",
    "Tenure2": "CAST(Tenure AS DOUBLE) * Tenure",
    "Products_per_Tenure": "CAST(NumOfProducts AS DOUBLE) / (CAST(Tenure AS DOUBLE) + 1)",
    "Balance_per_Tenure": "Balance / (CAST(Tenure AS DOUBLE) + 1)",
}
_BINARY = {n for n, s in FEATURE_SQL.items() if s.startswith("coalesce(")}


def _sql_select(names: list[str]) -> str:
    return ", ".join(
        f"{FEATURE_SQL[n]} AS {n}" if n in _BINARY else f"round({FEATURE_SQL[n]}, 6) AS {n}"
        for n in names)


# --- flagship: churn rate by the low-balance flag ---------------------------

FLAGSHIP_FEATURES = ["no_balance", "Balance_per_Product", "Inactive_x_Balance"]


@query("churn_rate_by_balance_flag", oracle=f"""{C360},
f AS (SELECT Exited, {FEATURE_SQL['no_balance']} AS no_balance,
             {FEATURE_SQL['Balance_per_Product']} AS bpp,
             {FEATURE_SQL['Inactive_x_Balance']} AS ixb FROM customer360)
SELECT no_balance, round(avg(Exited), 6) AS rate, count(*) AS n,
       round(avg(bpp), 6) AS mean_Balance_per_Product,
       round(avg(ixb), 6) AS mean_Inactive_x_Balance
FROM f GROUP BY no_balance""")
def churn_rate_by_balance_flag(spark, sf_dir):
    c = customer360(spark, sf_dir)
    f = add_features(c, FLAGSHIP_FEATURES)
    return rounded(rate_by_category(f, "no_balance", "Exited",
                                    means=["Balance_per_Product", "Inactive_x_Balance"]))


# --- all 30 derived features -------------------------------------------------

@query("derived_features", oracle=f"""{C360}
SELECT CustomerId, {_sql_select(fixed_features())} FROM customer360""")
def derived_features(spark, sf_dir):
    c = customer360(spark, sf_dir)
    f = add_features(c, fixed_features(), categories=C360_CATEGORIES)
    return rounded(f.select("CustomerId", *fixed_features()))


# --- layout-driven pruning: only features the layout names are computed ---

LAYOUT = ["Geography", "Age", "is_germany", "Num_Of_Products_2", "WealthScore",
          "LogAge", "Balance_to_Salary", "IsActiveMember"]


@query("layout_features", oracle=f"""{C360}
SELECT CustomerId, {_sql_select(required_features(LAYOUT))} FROM customer360""")
def layout_features(spark, sf_dir):
    need = required_features(LAYOUT)
    f = add_features(customer360(spark, sf_dir), need, categories=C360_CATEGORIES)
    return rounded(f.select("CustomerId", *need))


# --- float32 model input: numbers cast, bad text null -----------------------

@query("model_input_float32", oracle=f"""{C360}
SELECT CustomerId, CAST(Age AS FLOAT) AS Age, CAST(Balance AS FLOAT) AS Balance,
       CAST(coalesce(Balance < 2500, false) AS FLOAT) AS no_balance,
       TRY_CAST(Gender AS FLOAT) AS Gender
FROM customer360""")
def model_input_float32(spark, sf_dir):
    from driftwood.functions.names import to_float32
    f = add_features(customer360(spark, sf_dir), ["no_balance"])
    return to_float32(f.select("CustomerId", "Age", "Balance", "no_balance", "Gender"),
                      exclude=["CustomerId"])
