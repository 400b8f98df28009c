"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash
range, and the ``LEAST`` smallest hashes in any case, so that short texts
have one too.  It is the sorted array of those hashes.  Sketches merge: the
union of two, pruned by the same rule, is the sketch of the union.

All hashes up to a sketch's reach are in it: everything if it has fewer than
``LEAST`` hashes, else the larger of the fraction and its ``LEAST``-th hash.
``likeness`` compares two sketches up to the smaller reach and estimates how
much of the smaller shingle set the larger one contains, which stays
meaningful when one document is many times longer than the other.

Built-in functions only.  One shuffle carries the texts: rows are dealt to
ranges of the id (split points are approximate quantiles, as many as there
are buckets, so their number is bounded by the partition count), a window
inside a range finds each next document, and a row per range bridges ranges.

Defined cases: null texts are empty; a text without words has the empty
sketch, which is wholly like another empty one and not at all like any other;
fewer words than a shingle make one shingle.  Rows with equal ids follow one
another in the order of their texts; null ids come last in descending order.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.llm.common import SPACE, partitions

SHINGLE = 5
#: Share of the hash range that is kept, as 2**-FRACTION_BITS.
FRACTION_BITS = 3
#: Smallest hashes that are kept whatever their size.
LEAST = 16


def limit(bits: int = FRACTION_BITS) -> int:
    """Hashes (signed 64 bit) below this are kept."""
    return -(1 << 63) + (1 << (64 - bits))


def words(text: Column) -> Column:
    clean = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(F.length(clean) == 0, F.array().cast("array<string>")).otherwise(F.split(clean, SPACE))


def hashes(text: Column) -> Column:
    """The hash of every word."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def sketch(hashed: Column, shingle: int = SHINGLE, bits: int = FRACTION_BITS,
           least: int = LEAST) -> Column:
    """The sketch of a text's word hashes."""
    n = F.size(hashed)
    at = lambda i, k: F.get(hashed, i + k)
    full = F.transform(F.sequence(F.lit(0), n - shingle),
                       lambda i: F.xxhash64(*[at(i, k) for k in range(shingle)]))
    short = F.array(F.xxhash64(hashed))
    return prune(F.when(n == 0, F.array().cast("array<bigint>")).when(n < shingle, short).otherwise(full),
                 bits, least)


def prune(values: Column, bits: int = FRACTION_BITS, least: int = LEAST) -> Column:
    ordered = F.sort_array(F.array_distinct(values))
    return F.filter(ordered, lambda x, i: (x < F.lit(limit(bits))) | (i < least))


def merge(a: Column, b: Column, bits: int = FRACTION_BITS, least: int = LEAST) -> Column:
    """The sketch of the union of two documents' shingles."""
    return prune(F.concat(a, b), bits, least)


def likeness(a: Column, b: Column, bits: int = FRACTION_BITS, least: int = LEAST) -> Column:
    """Estimated containment of the smaller shingle set in the larger."""
    reach = lambda s: F.when(F.size(s) < least, F.lit((1 << 63) - 1)).otherwise(
        F.greatest(F.lit(limit(bits) - 1), F.element_at(s, least)))
    common = F.array_intersect(a, b)
    up_to = F.least(reach(a), reach(b))
    within = lambda s: F.size(F.filter(s, lambda x: x <= up_to))
    smaller = F.least(within(a), within(b))
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
            .when(smaller == 0, F.lit(0.0))
            .otherwise(within(common) / smaller).cast("double"))


def printed(s: Column) -> Column:
    """A sketch as text: 16 hex digits per hash."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def with_next(df: DataFrame, id_col: str, order_col: str, prepare) -> DataFrame:
    """``prepare(df)`` plus next_<col>, for each of its columns, of the row
    with the next smaller id; after the last row comes the first.  Ids must
    be numbers.  ``prepare`` adds columns row by row."""
    spark = df.sparkSession
    n = 4 * partitions(spark)
    number = F.col(id_col).cast("double")
    points = df.select(F.percentile_approx(number, [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    splits = [float("-inf"), *sorted(set(points) or {0.0}), float("inf")]
    dealt = Bucketizer(splits=splits, inputCol="__number", outputCol="__bucket", handleInvalid="keep") \
        .transform(df.withColumn("__number", F.coalesce(number, F.lit(float("-inf"))))) \
        .withColumn("__bucket", F.when(F.col(id_col).isNull(), -1).otherwise(F.col("__bucket").cast("int"))) \
        .drop("__number")
    full = prepare(dealt)
    cols = [c for c in full.columns if c != "__bucket"]
    inside = Window.partitionBy("__bucket").orderBy(F.col(id_col).desc(), F.col(order_col))
    rows = full.select("*", *[F.lead(c).over(inside).alias(f"next_{c}") for c in cols],
                       F.lead(F.lit(True)).over(inside).alias("__has_next"))
    # the first row of every range: found by its id alone, prepared after that
    tops = dealt.groupBy("__bucket").agg(F.max(id_col).alias("__top"))
    ring = Window.orderBy(F.col("__bucket").desc())
    every = Window.partitionBy()
    tops = tops.select("__bucket", "__top", F.coalesce(F.lead("__bucket").over(ring),
                                                       F.max("__bucket").over(every)).alias("__then"))
    first = F.row_number().over(Window.partitionBy("__bucket").orderBy(F.col(order_col)))
    heads = (dealt.join(F.broadcast(tops.select("__bucket", "__top")), "__bucket")  # a row per range
             .where(F.col(id_col).eqNullSafe(F.col("__top"))).drop("__top")
             .withColumn("__first", first).where("__first = 1").drop("__first"))
    heads = prepare(heads).select(F.col("__bucket").alias("__then"), *[F.col(c).alias(f"head_{c}") for c in cols])
    out = rows.join(tops.select("__bucket", "__then").join(heads, "__then"), "__bucket")
    return out.select(*cols, *[
        F.when(F.col("__has_next"), F.col(f"next_{c}")).otherwise(F.col(f"head_{c}")).alias(f"next_{c}")
        for c in cols])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sketch array<long>) of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (docs.select(F.col(id_col), hashes(text).alias("hashed"))
            .select(id_col, sketch(F.col("hashed")).alias("sketch")))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text beside its edited form (its last half replaced by as much
    of the next document's beginning) and the likeness of its sketch to the
    edited text's and to the next document's."""
    base = docs.select(F.col(id_col).alias("id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def sketched(rows: DataFrame) -> DataFrame:
        return (rows.withColumn("hashed", hashes(F.col("text")))
                .withColumn("sketch", sketch(F.col("hashed"))).drop("hashed"))

    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - half),
                      F.substr(F.col("next_text"), F.lit(1), half))
    both = (with_next(base, "id", "text", sketched)
            .select("id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
            .select("*", hashes(F.col("edited")).alias("hashed"))
            .select("id", "n_chars", "sketch", "next_sketch", F.sha2("edited", 256).alias("edited_sha256"),
                    sketch(F.col("hashed")).alias("edited_sketch")))
    return both.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256",
        printed(F.col("sketch")).alias("fingerprint"),
        printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
