"""Mixing sources to target weights along a training run.

Sources, in code point order with null last, take the weights in turn and
share ``budget`` times all words; no source gets more than ``cap`` times its
own words, and what it leaves is reshared by weight (water filling, solved
in closed form: sorted by words per weight, the capped sources come first).

Within a source, documents queue in a fixed pseudo-random order (md5 of the
id).  Each is taken ``floor(target / source words)`` times; one more time if
its middle lies in the first ``target mod source words`` words of the queue.

Curriculum: source i is drawn at rate ``target_i * (1 + a_i (2t - 1))`` at
training time t in [0, 1], with slope ``a_i`` in [-1, 1]: sources with a
negative slope are front-loaded.  The integral of that rate is the cumulative
demand; inverting it at a copy's place in the queue gives its position, and
``expand`` range-sorts the copies by position.  ``words_taken`` counts what
the sorted copies hold per document.

Scale: queue sums are taken per (source, bucket of the md5), so that a source
holding a third of all rows is spread over every bucket; one window runs
inside a bucket, another over bucket sums, one over source sums (a row per
source; the only single-partition step).

Defined cases: null or wordless texts have size 0 and are taken 0 times;
null sources form one source; rows with the same id are separate rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.llm.common import cut, n_words, partitions

WEIGHTS = (5, 2, 1)
#: Rate slopes that go with the weights: heavy sources early, light ones late.
SLOPES = (-0.5, 0.0, 0.5)


def source_targets(sums: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES,
                   budget: tuple = (3, 2), cap: int = 2) -> DataFrame:
    """(src, source, source_size) -> plus slope and target, a row per source.
    ``budget`` is a fraction; all comparisons are exact in integers."""
    num, den = budget
    turn = (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % len(weights)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (turn + 1).cast("int"))
    s = sums.select("src", "source", "source_size", pick(weights).cast("long").alias("w"),
                    pick(slopes).alias("slope"), turn.alias("turn"))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.select("*", F.sum("source_size").over(everything).alias("total"), before.alias("before"),
                 F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)).alias("w_after"))
    left = F.col("total") * num - F.col("before") * (cap * den)  # times den
    s = s.withColumn("left", left).withColumn(
        "full", F.col("w") * F.col("left") >= F.col("source_size") * F.col("w_after") * (cap * den))
    s = s.withColumn("share_left", F.max(F.when(~F.col("full"), F.col("left"))).over(everything)) \
         .withColumn("share_w", F.max(F.when(~F.col("full"), F.col("w_after"))).over(everything))
    target = F.when(F.col("full"), F.col("source_size") * float(cap)).otherwise(
        F.col("w") * F.col("share_left") / (F.col("share_w") * float(den)))
    return s.select("src", "source_size", "slope", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights: tuple = WEIGHTS, slopes: tuple = SLOPES,
        budget: tuple = (3, 2), cap: int = 2, carry: bool = False) -> DataFrame:
    """Per document: id, size, source_size, target, taken, copies and the
    training positions of its copies.  ``carry`` keeps every input column, as
    a struct named ``doc``."""
    spark = docs.sparkSession
    buckets = 4 * partitions(spark)
    source = F.col(source_col).cast("string")
    key = F.coalesce(F.md5(F.col(id_col).cast("string")), F.lit(""))
    place = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    sized = docs.select(
        F.col(id_col).alias("id"), source.alias("source"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("src"),
        n_words(F.col(text_col)).alias("size"), key.alias("key"),
        F.coalesce(F.shiftright(place * buckets, 32), F.lit(0)).cast("int").alias("bucket"),
        *([F.struct(*[docs[c] for c in docs.columns]).alias("doc")] if carry else []))
    if not carry:
        sized = cut(sized)  # narrow; saves counting the words of every text again
    by_bucket = sized.groupBy("src", "source", "bucket").agg(F.sum("size").alias("words"))
    targets = source_targets(by_bucket.groupBy("src", "source").agg(F.sum("words").alias("source_size")),
                             weights, slopes, budget, cap)
    ahead = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = (by_bucket.select("src", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
            .join(targets, "src"))
    queue = (Window.partitionBy("src", "bucket").orderBy("key", "id", "size")
             .rowsBetween(Window.unboundedPreceding, -1))
    q = (sized.withColumn("inside", F.coalesce(F.sum("size").over(queue), F.lit(0)))
         .join(plan, ["src", "bucket"])
         .withColumn("start", F.col("ahead") + F.col("inside")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    q = q.withColumn("whole", whole.cast("long"))
    spare = F.col("target") - F.col("whole") * F.col("source_size")
    extra = (2 * F.col("start") + F.col("size") <= 2 * spare) & (F.col("whole") < cap)
    q = q.withColumn("copies", F.when(F.col("size") == 0, 0)
                     .otherwise(F.col("whole") + extra.cast("long")).cast("int"))
    a = F.col("slope")
    demand = lambda e: F.least(F.lit(1.0), (e * F.col("source_size") + F.col("start")
                                            + F.col("size") / 2) / F.col("target"))
    when = lambda d: F.when(a == 0, d).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0),
        (F.sqrt((1 - a) * (1 - a) + 4 * a * d) - (1 - a)) / (2 * a))))
    positions = F.when(F.col("copies") > 0, F.transform(
        F.sequence(F.lit(0), F.col("copies") - 1), lambda e: when(demand(e)))) \
        .otherwise(F.array().cast("array<double>"))
    return q.select(F.col("id").alias(id_col), "size", "source_size", "target",
                    (F.col("copies") * F.col("size")).alias("taken"), "copies",
                    positions.alias("positions"), *(["doc"] if carry else []))


def scheduled(positions: Column) -> Column:
    """The number of copies that the schedule places in training time."""
    return F.size(F.filter(positions, lambda t: (t >= 0) & (t <= 1))).cast("long")


def expand(mixed: DataFrame, id_col: str = "doc_id", untaken: bool = False) -> DataFrame:
    """One row per copy, range-sorted by training position; ``untaken`` adds,
    at the end, a row without a position per document that has no copy."""
    explode = F.explode_outer if untaken else F.explode
    return (mixed.withColumn("position", explode("positions"))
            .orderBy(F.asc_nulls_last("position"), F.md5(F.col(id_col).cast("string"))))


def words_taken(mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``mixed`` (with ``doc``) laid out as the training run: every copy of a
    whole document at its position.  Per document, in the order in which the
    run meets them (without a copy: last): id, size, source_size, target and
    taken, the words of its copies as counted in the run."""
    rows = (mixed.withColumn("row", F.monotonically_increasing_id())  # ids may repeat
            .withColumn("doc", F.when(F.size("positions") > 0, F.col("doc"))))
    run = expand(rows, id_col, untaken=True).withColumn("place", F.monotonically_increasing_id())
    words = n_words(F.col("doc")[text_col]) * scheduled(F.array("position"))
    return (run.groupBy("row", id_col, "size", "source_size", "target")
            .agg(F.sum(words).alias("taken"), F.min("place").alias("place")).orderBy("place")
            .select(id_col, "size", "source_size", "target", "taken"))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(md5(doc_id::VARCHAR), '') AS k,
         COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (
  SELECT source, SUM(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM d GROUP BY source),
f AS (
  SELECT *, (SUM(source_size) OVER ())::BIGINT AS total,
         COALESCE(SUM(source_size) OVER (ORDER BY source_size / w, source IS NULL, source
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         (SUM(w) OVER (ORDER BY source_size / w, source IS NULL, source
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS w_after FROM s),
g AS (SELECT *, w * (total * 3 - before * 4) >= source_size * w_after * 4 AS is_full FROM f),
t AS (
  SELECT source, source_size, CASE WHEN is_full THEN source_size * 2.0::DOUBLE
         ELSE w * (MAX(CASE WHEN NOT is_full THEN total * 3 - before * 4 END) OVER ())
              / ((MAX(CASE WHEN NOT is_full THEN w_after END) OVER ()) * 2.0::DOUBLE) END AS target FROM g),
q AS (
  SELECT d.*, source_size, target,
         COALESCE(SUM(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
         CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN size > 0 AND whole < 2
               AND 2 * start + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END) AS taken
FROM q
"""
