"""Churn-shaped customer table derived from the TPC-H-like tables.

One row per customer.  Orders are aggregated per customer first (partial
aggregation map-side, so a customer holding a third of all orders still
collapses to one row per task before the shuffle), then joined to the
customer table on the key the aggregate is already partitioned by.  The
nation/region dimensions are left to Catalyst's size-checked broadcast
(``autoBroadcastJoinThreshold``).

Columns without a source in the test tables (Age, CreditScore, HasCrCard,
Gender) are synthetic arithmetic stand-ins on the customer key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.sources.tables import table

DEFAULT_CUTOFF = "2001-01-01"

CHURN_COLUMNS = ["CustomerId", "Surname", "CreditScore", "Geography", "Gender",
                 "Age", "Tenure", "Balance", "NumOfProducts", "HasCrCard",
                 "IsActiveMember", "EstimatedSalary", "Card Type", "Exited"]


def customer360(spark: SparkSession, sf_dir: str,
                cutoff: str = DEFAULT_CUTOFF) -> DataFrame:
    cust = table(spark, sf_dir, "customer",
                 ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    nation = table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    region = table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    orders = table(spark, sf_dir, "orders", ["o_custkey", "o_totalprice", "o_orderdate"])

    cut = F.lit(cutoff).cast("timestamp_ntz")
    year_start = F.add_months(cut, -12).cast("timestamp_ntz")
    before = F.col("o_orderdate") < cut
    yr = F.year("o_orderdate")
    per_cust = orders.groupBy("o_custkey").agg(
        F.count_if(before).alias("n_before"),
        F.avg(F.when(before, F.col("o_totalprice"))).alias("salary"),
        F.min(F.when(before, yr)).alias("first_year"),
        F.max(F.when(before, yr)).alias("last_year"),
        F.bool_or(before & (F.col("o_orderdate") >= year_start)).alias("active"),
        F.bool_or(~before).alias("stayed"),
    )

    key = F.col("c_custkey")
    geo = (nation.join(region, nation.n_regionkey == region.r_regionkey)
           .select("n_nationkey", "r_name"))
    return (cust.join(geo, cust.c_nationkey == geo.n_nationkey, "left")
            .join(per_cust, cust.c_custkey == per_cust.o_custkey, "left")
            .select(
                key.alias("CustomerId"),
                F.col("c_name").alias("Surname"),
                # synthetic stand-ins
                (F.lit(350) + F.pmod(key * 37, F.lit(501))).cast("int").alias("CreditScore"),
                F.col("r_name").alias("Geography"),
                F.when(F.pmod(key, F.lit(2)) == 0, "Female").otherwise("Male").alias("Gender"),
                (F.lit(18) + F.pmod(key, F.lit(60))).cast("int").alias("Age"),
                (F.col("last_year") - F.col("first_year")).cast("int").alias("Tenure"),
                F.col("c_acctbal").alias("Balance"),
                (F.lit(1) + F.pmod(F.coalesce("n_before", F.lit(0)), F.lit(4)))
                .cast("int").alias("NumOfProducts"),
                F.when(F.pmod(key, F.lit(3)) == 0, 0).otherwise(1).cast("int").alias("HasCrCard"),
                F.coalesce(F.col("active"), F.lit(False)).cast("int").alias("IsActiveMember"),
                F.col("salary").alias("EstimatedSalary"),
                F.col("c_mktsegment").alias("Card Type"),
                F.when(F.coalesce("stayed", F.lit(False)), 0).otherwise(1)
                .cast("int").alias("Exited"),
            ))


def customer360_sql(cutoff: str = DEFAULT_CUTOFF, name: str = "customer360") -> str:
    """The same table as a DuckDB CTE body (``name AS (...)``)."""
    return f"""{name} AS (
  WITH per_cust AS (
    SELECT o_custkey,
           count(*) FILTER (WHERE o_orderdate < TIMESTAMP '{cutoff}') AS n_before,
           avg(CASE WHEN o_orderdate < TIMESTAMP '{cutoff}' THEN o_totalprice END) AS salary,
           min(CASE WHEN o_orderdate < TIMESTAMP '{cutoff}' THEN year(o_orderdate) END) AS first_year,
           max(CASE WHEN o_orderdate < TIMESTAMP '{cutoff}' THEN year(o_orderdate) END) AS last_year,
           bool_or(o_orderdate < TIMESTAMP '{cutoff}'
                   AND o_orderdate >= TIMESTAMP '{cutoff}' - INTERVAL 12 MONTH) AS active,
           bool_or(o_orderdate >= TIMESTAMP '{cutoff}') AS stayed
    FROM orders GROUP BY o_custkey)
  SELECT c.c_custkey AS CustomerId,
         c.c_name AS Surname,
         CAST(350 + (c.c_custkey * 37) % 501 AS INTEGER) AS CreditScore,
         r.r_name AS Geography,
         CASE WHEN c.c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS Gender,
         CAST(18 + c.c_custkey % 60 AS INTEGER) AS Age,
         CAST(p.last_year - p.first_year AS INTEGER) AS Tenure,
         c.c_acctbal AS Balance,
         CAST(1 + coalesce(p.n_before, 0) % 4 AS INTEGER) AS NumOfProducts,
         CAST(CASE WHEN c.c_custkey % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS HasCrCard,
         CAST(coalesce(p.active, false) AS INTEGER) AS IsActiveMember,
         p.salary AS EstimatedSalary,
         c.c_mktsegment AS "Card Type",
         CAST(CASE WHEN coalesce(p.stayed, false) THEN 0 ELSE 1 END AS INTEGER) AS Exited
  FROM customer c
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN per_cust p ON c.c_custkey = p.o_custkey)"""


# Category literals the binding uses in place of the churn values
# (Geography holds region names, Card Type holds market segments).
C360_CATEGORIES = {
    "is_germany": "EUROPE",
    "is_spain": "ASIA",
    "is_france": "AMERICA",
    "is_silver": "AUTOMOBILE",
}
