"""Search-range suggestion from a table of search trials (number, state,
value, params map<string,double>).

Over COMPLETE trials: the top trials are those with value >= the 0.95
quantile of value.  For every parameter with at least 5 non-null values and
a non-zero span (max - min), the position of the top trials' median in the
range decides the action:

  pos < 0.15          move_left:  [min - 0.5 span, max]
  pos > 0.85          move_right: [min, max + 0.5 span]
  (q90 - q10)/span < 0.40 of the top trials  narrow: [q10 - p, q90 + p], p = 0.2 (q90 - q10)
  otherwise           keep:       [min, max]

All quantiles are exact with linear interpolation; every parameter is
handled in the same jobs (the parameter map is exploded to rows).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.operators.selection import exact_quantiles


def suggest_ranges(trials: DataFrame, top_quantile: float = 0.95,
                   boundary: float = 0.15, expansion: float = 0.5,
                   narrow_below: float = 0.40, padding: float = 0.20,
                   min_values: int = 5) -> DataFrame:
    complete = trials.where(F.col("state") == "COMPLETE")
    thr = exact_quantiles(complete.select("value"), "value", [top_quantile]).select("q_0").scalar()
    long = (complete.select("value", F.explode("params").alias("parameter", "p"))
            .where(F.col("p").isNotNull() & ~F.isnan("p")))
    stats = long.groupBy("parameter").agg(F.count(F.lit(1)).alias("n"),
                                          F.min("p").alias("current_min"),
                                          F.max("p").alias("current_max"))
    top = long.where(F.col("value") >= thr).select("parameter", "p")
    tq = exact_quantiles(top, "p", [0.1, 0.5, 0.9], by=["parameter"]) \
        .select("parameter", F.col("q_0").alias("q10"), F.col("q_1").alias("best_median"),
                F.col("q_2").alias("q90"))
    span = F.col("current_max") - F.col("current_min")
    eligible = stats.where((F.col("n") >= min_values) & (span != 0))
    j = eligible.join(tq, "parameter", "left")
    pos = (F.col("best_median") - F.col("current_min")) / span
    conc = (F.col("q90") - F.col("q10")) / span
    pad = (F.col("q90") - F.col("q10")) * padding
    action = (F.when(pos < boundary, "move_left")
              .when(pos > 1 - boundary, "move_right")
              .when(conc < narrow_below, "narrow").otherwise("keep"))
    j = j.withColumn("action", action)
    lo = (F.when(F.col("action") == "move_left", F.col("current_min") - expansion * span)
          .when(F.col("action") == "narrow", F.col("q10") - pad)
          .otherwise(F.col("current_min")))
    hi = (F.when(F.col("action") == "move_right", F.col("current_max") + expansion * span)
          .when(F.col("action") == "narrow", F.col("q90") + pad)
          .otherwise(F.col("current_max")))
    return j.select("parameter", "current_min", "current_max", "best_median", "action",
                    lo.alias("suggested_min"), hi.alias("suggested_max")) \
        .orderBy("action", "parameter")


def parzen_ratio(trials: DataFrame, candidates: DataFrame, top_quantile: float = 0.75,
                 prior: float = 1.0) -> DataFrame:
    """(candidate, log_ratio): how much likelier a candidate is among the good
    trials than among the others, the sum over parameters of the log ratio of
    two Parzen densities.

    Good trials are the complete ones at or above the quantile.  A density is a
    mean of Gaussian kernels at the trials' values (Scott's bandwidth from the
    population deviation, at least a hundredth of the range) and of ``prior``
    uniform ones over the range.  Parameters of one value say nothing and are
    left out.  ``candidates`` has candidate, parameter and p, a row per
    parameter.  Equal trial values are counted first: the work is candidates x
    distinct values of a parameter, joined by parameter."""
    complete = trials.where((F.col("state") == "COMPLETE") & F.col("value").isNotNull() & ~F.isnan("value"))
    least = exact_quantiles(complete.select("value"), "value", [top_quantile]).select("q_0").scalar()
    long = (complete.select((F.col("value") >= least).alias("good"), F.explode("params").alias("parameter", "p"))
            .where(F.col("p").isNotNull() & ~F.isnan("p")))
    counted = long.groupBy("parameter", "good", "p").agg(F.count(F.lit(1)).alias("w"))
    span = long.groupBy("parameter").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).where("lo < hi")
    size = long.groupBy("parameter", "good").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("p").alias("sd"))
    width = F.col("hi") - F.col("lo")
    # a side without trials has its prior only
    sides = span.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("good")) \
        .join(size, ["parameter", "good"], "left") \
        .select("parameter", "good", width.alias("width"), F.coalesce("n", F.lit(0)).alias("n"),
                F.greatest(F.coalesce(F.col("sd"), F.lit(0.0)) * F.pow(F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)), F.lit(-0.2)),
                           width / 100).alias("h"))
    z = (F.col("x") - F.col("p")) / F.col("h")
    kernel = F.col("w") * F.exp(-0.5 * z * z) / (F.col("h") * math.sqrt(2 * math.pi))
    at = candidates.select("candidate", "parameter", F.col("p").cast("double").alias("x"))
    mass = (at.join(sides, "parameter").join(counted, ["parameter", "good"], "left")
            .groupBy("candidate", "parameter", "good", "width", "n").agg(F.coalesce(F.sum(kernel), F.lit(0.0)).alias("s")))
    density = (prior / F.col("width") + F.col("s")) / (F.col("n") + prior)
    side = F.when(F.col("good"), F.log(density)).otherwise(-F.log(density))
    return mass.groupBy("candidate").agg(F.sum(side).alias("log_ratio"))
