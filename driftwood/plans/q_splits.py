"""Split queries (K1-K5, A15).  Row membership depends on Spark's xxhash64,
so the oracles check what the contract fixes: exact per-class counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwood.operators import splits as K
from driftwood.operators.profile import split_sizes
from driftwood.plans.catalog import query
from driftwood.plans.customer360 import customer360, customer360_sql

C360 = "WITH " + customer360_sql()

_EXPECTED = f"""{C360},
cls AS (SELECT Exited, count(*) AS n FROM customer360 GROUP BY Exited),
t AS (SELECT Exited, n, CAST(floor(n * CAST(0.2 AS DOUBLE) + 0.5) AS BIGINT) AS n_test FROM cls),
v AS (SELECT Exited, n, n_test,
             CAST(floor((n - n_test) * CAST(0.2 AS DOUBLE) + 0.5) AS BIGINT) AS n_val FROM t),
counts AS (SELECT 'test' AS split, Exited, n_test AS n FROM v
           UNION ALL SELECT 'val', Exited, n_val FROM v
           UNION ALL SELECT 'train', Exited, n - n_test - n_val FROM v)"""


@query("stratified_split_counts", oracle=f"""{_EXPECTED}
SELECT split, Exited, n FROM counts""")
def stratified_split_counts(spark, sf_dir):
    s = K.stratified_split(customer360(spark, sf_dir), "Exited", "CustomerId",
                           test_size=0.2, val_size=0.2, seed=43)
    return s.groupBy("split", "Exited").agg(F.count(F.lit(1)).alias("n"))


@query("split_sizes", oracle=f"""{_EXPECTED}
SELECT split, sum(n)::BIGINT AS rows, 14 AS columns FROM counts GROUP BY split""")
def split_sizes_query(spark, sf_dir):
    s = K.stratified_split(customer360(spark, sf_dir), "Exited", "CustomerId",
                           test_size=0.2, val_size=0.2, seed=43)
    return split_sizes(s, "split")


@query("stratified_fold_counts", oracle=f"""{C360},
cls AS (SELECT Exited, count(*) AS n FROM customer360 GROUP BY Exited),
f AS (SELECT CAST(range AS INTEGER) AS fold FROM range(5))
SELECT f.fold, cls.Exited, CAST(n // 5 + CASE WHEN f.fold < n % 5 THEN 1 ELSE 0 END AS BIGINT) AS n
FROM cls CROSS JOIN f""")
def stratified_fold_counts(spark, sf_dir):
    f = K.stratified_folds(customer360(spark, sf_dir), "Exited", "CustomerId", k=5, seed=42)
    return f.groupBy("fold", "Exited").agg(F.count(F.lit(1)).alias("n"))


@query("seeded_sample_size", oracle=f"""{C360}
SELECT least(100, count(*)) AS n_rows, least(100, count(DISTINCT CustomerId)) AS n_keys
FROM customer360""")
def seeded_sample_size(spark, sf_dir):
    s = K.seeded_sample(customer360(spark, sf_dir), "CustomerId", 100, seed=42)
    return s.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_distinct("CustomerId").alias("n_keys"))


@query("random_split_sizes")
def random_split_sizes(spark, sf_dir):
    s = K.random_split(customer360(spark, sf_dir), test_size=0.2, seed=42)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("hash_split_sizes")
def hash_split_sizes(spark, sf_dir):
    s = K.hash_split(customer360(spark, sf_dir), "CustomerId", test_size=0.2, seed=42)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
