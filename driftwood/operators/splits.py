"""Train / validation / test splits, stratified folds and seeded samples.

Row identity is a key column (Spark rows have no order).  Reproducibility
is by key: a row's position in the shuffled order is
``(xxhash64(key, seed), key)``, independent of partitioning.

Stratified splits give exact per-class counts (test = round(f * n_class)).
Ranking each class with one window would put a whole class in one task, so
rows are bucketed by the top bits of their hash (uniform, monotone in the
order), bucket counts per class are summed in a table of at most
``classes x 2^bits`` rows, and only buckets that straddle a cut-off are
shuffled and ranked; all other rows are decided map-side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.session import shuffle_partitions

BROADCAST_ROWS = 1_000_000  # largest (class, bucket) table joined by broadcast


def _hash(key: str, seed: int) -> Column:
    return F.xxhash64(F.col(f"`{key}`"), F.lit(seed))


def _bits(df: DataFrame, bits: int | None) -> int:
    if bits:
        return bits
    return max(4, min(20, math.ceil(math.log2(max(2, shuffle_partitions(df.sparkSession) * 8)))))


def _bucket(h: Column, bits: int) -> Column:
    return F.shiftright(h, 64 - bits).cast("int")


def _class(label: str) -> Column:
    """Class id as text; a null label is a class of its own."""
    return F.coalesce(F.col(f"`{label}`").cast("string"), F.lit("\u0000null"))


def _bounded(df: DataFrame, label: str, bits: int, small: DataFrame) -> DataFrame:
    """The (class, bucket) table, broadcast only when classes x 2^bits is
    within ``BROADCAST_ROWS`` (class count from one single-column scan);
    otherwise left to a regular join."""
    classes = df.agg(F.approx_count_distinct(F.col(f"`{label}`"))).first()[0] or 1
    return F.broadcast(small) if (classes + 1) * (1 << bits) <= BROADCAST_ROWS else small


def _round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def _prefix(df: DataFrame) -> str:
    """A prefix for helper columns that no column of ``df`` starts with."""
    p = "_dw_"
    while any(c.lower().startswith(p) for c in df.columns):
        p += "_"
    return p


def _class_bucket_table(df: DataFrame, label: str, key: str, seed: int,
                        bits: int, p: str) -> DataFrame:
    """(class y, bucket b, rows n, rows of the class in earlier buckets, class
    size ny), names prefixed: at most classes x 2^bits rows; the class count
    is checked."""
    h = _hash(key, seed)
    counts = df.groupBy(_class(label).alias(p + "y"), _bucket(h, bits).alias(p + "b")) \
        .agg(F.count(F.lit(1)).alias(p + "n"))
    w = Window.partitionBy(p + "y").orderBy(p + "b")
    return counts.select(
        p + "y", p + "b", p + "n",
        F.coalesce(F.sum(p + "n").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias(p + "before"),
        F.sum(p + "n").over(Window.partitionBy(p + "y")).alias(p + "ny"))


def _hashed(df: DataFrame, label: str, key: str, seed: int, bits: int, p: str) -> DataFrame:
    return df.withColumn(p + "h", _hash(key, seed)).withColumn(p + "b", _bucket(F.col(p + "h"), bits)) \
        .withColumn(p + "y", _class(label))


def _and(df: DataFrame, name: str, value: Column) -> list:
    """The columns of ``df`` and one more, which takes the place of one of
    its name."""
    return [F.col(f"`{c}`") for c in df.columns if c != name] + [value.alias(name)]


def stratified_split(df: DataFrame, label: str, key: str, test_size: float = 0.2,
                     val_size: float | None = None, seed: int = 43,
                     split_col: str = "split", bucket_bits: int | None = None) -> DataFrame:
    """Add ``split_col`` in {train, val, test}.

    Per class: test = round(test_size * n); val = round(val_size * (n - test))
    (the validation share is of the remainder); train = the rest.  All other
    columns of ``df`` stay, whatever their names.
    """
    bits, p = _bits(df, bucket_bits), _prefix(df)
    table = _class_bucket_table(df, label, key, seed, bits, p)
    before, after, t, tv, mixed = (F.col(p + c) for c in ("before", "after", "t", "tv", "mixed"))
    n_test = _round_half_up(F.col(p + "ny") * test_size)
    n_val = _round_half_up((F.col(p + "ny") - n_test) * (val_size or 0.0))
    cuts = table.select(p + "y", p + "b", p + "before", (before + F.col(p + "n")).alias(p + "after"),
                        n_test.alias(p + "t"), (n_test + n_val).alias(p + "tv"))
    # a bucket is decided when no cut-off falls strictly inside it
    straddles = ((before < t) & (t < after)) | ((before < tv) & (tv < after))
    cuts = cuts.withColumn(p + "mixed", straddles)
    tagged = _hashed(df, label, key, seed, bits, p) \
        .join(_bounded(df, label, bits, cuts), [p + "y", p + "b"], "inner")

    def name(rank: Column) -> Column:
        return F.when(rank < t, "test").when(rank < tv, "val").otherwise("train")

    decided = tagged.where(~mixed).select(_and(df, split_col, name(before)))
    order = Window.partitionBy(p + "y", p + "b").orderBy(p + "h", f"`{key}`")
    ranked = tagged.where(mixed).withColumn(p + "r", F.row_number().over(order) - 1)
    return decided.unionByName(ranked.select(_and(df, split_col, name(before + F.col(p + "r")))))


def _ranked(df: DataFrame, label: str, key: str, seed: int, bucket_bits: int | None, p: str) -> DataFrame:
    """``df`` with each row's 0-based place in its class's seeded order
    (prefixed ``rank``) and the class size (``ny``)."""
    bits = _bits(df, bucket_bits)
    offsets = _class_bucket_table(df, label, key, seed, bits, p).drop(p + "n")
    order = Window.partitionBy(p + "y", p + "b").orderBy(p + "h", f"`{key}`")
    rows = _hashed(df, label, key, seed, bits, p).withColumn(p + "r", F.row_number().over(order) - 1)
    return rows.join(_bounded(df, label, bits, offsets), [p + "y", p + "b"], "left") \
        .withColumn(p + "rank", F.col(p + "before") + F.col(p + "r"))


def stratified_ranks(df: DataFrame, label: str, key: str, seed: int = 42,
                     bucket_bits: int | None = None) -> DataFrame:
    """Add ``_rank`` (0-based position of the row within its class in the
    seeded order) and ``_class_n``; every row is ranked, partitioned by
    (class, hash bucket)."""
    p = _prefix(df)
    return _ranked(df, label, key, seed, bucket_bits, p).select(
        *[F.col(f"`{c}`") for c in df.columns if c not in ("_rank", "_class_n")],
        F.col(p + "rank").alias("_rank"), F.col(p + "ny").alias("_class_n"))


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42,
                     fold_col: str = "fold") -> DataFrame:
    """Stratified k-fold: rows of each class dealt round-robin over folds in
    the seeded order, so fold class counts differ by at most one.  All other
    columns of ``df`` stay."""
    p = _prefix(df)
    fold = F.pmod(F.col(p + "rank"), F.lit(k)).cast("int")
    return _ranked(df, label, key, seed, None, p).select(_and(df, fold_col, fold))


def random_split(df: DataFrame, test_size: float = 0.2, seed: int = 42,
                 split_col: str = "split") -> DataFrame:
    """Bernoulli split with ``randomSplit`` (counts are random)."""
    train, test = df.randomSplit([1 - test_size, test_size], seed=seed)
    return train.withColumn(split_col, F.lit("train")) \
        .unionByName(test.withColumn(split_col, F.lit("test")))


def hash_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42,
               split_col: str = "split") -> DataFrame:
    """Bernoulli split decided by the key's hash: repeatable for any
    partitioning, no shuffle."""
    u = F.pmod(_hash(key, seed), F.lit(1_000_000))
    return df.withColumn(split_col, F.when(u < int(test_size * 1_000_000), "test")
                         .otherwise("train"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement (all rows when fewer): the n smallest
    (hash, key); planned as a top-n, one bounded heap per task."""
    return df.orderBy(_hash(key, seed), F.col(f"`{key}`")).limit(n)


def split_frames(df: DataFrame, target: str, split_col: str = "split"):
    """Features and target of each split, keyed rows kept together
    (the reference's X_train / y_train pairs as projections)."""
    out = {}
    for s in ("train", "val", "test"):
        part = df.where(F.col(split_col) == s).drop(split_col)
        out[s] = (part.drop(target), part.select(target))
    return out
