"""Scale guards on physical plans: no cartesian / nested-loop joins, no
window over an unbounded table without a partition key."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__)), "tools"))

import __spark_entry__ as E  # noqa: E402
from plan_lint import plan_text, problems  # noqa: E402

from conftest import SF_SMALL  # noqa: E402

from driftwood.plans import q_models  # noqa: E402

# every query except the model ones (those fit models while being built)
MODEL_QUERIES = {n for n, f in E.queries().items()
                 if f.__module__ in (q_models.__name__, "driftwood.plans.q_checks")}
# the text subpackage lints its own plans
TEXT_QUERIES = {n for n, f in E.queries().items() if not f.__module__.startswith("driftwood.plans")}
ORACLED = sorted(n for n in E.queries() if n not in MODEL_QUERIES | TEXT_QUERIES)


@pytest.mark.parametrize("name", ORACLED)
def test_plan_has_no_scale_hazards(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    assert problems(name, plan_text(df)) == []


def test_lint_detects_hazards(spark):
    from pyspark.sql import Window, functions as F
    df = spark.range(10)
    assert "global Window" in problems("x", plan_text(
        df.withColumn("r", F.row_number().over(Window.orderBy("id")))))
    assert "BroadcastNestedLoopJoin" in problems("x", plan_text(
        df.join(spark.range(3).withColumnRenamed("id", "j"), F.col("id") < F.col("j"))))
