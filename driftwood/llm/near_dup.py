"""Near-duplicate documents by b-bit MinHash.

1. Texts with the same normalised words are one class; its smallest id
   stands for it from here on.
2. Each class's distinct shingles give ``BANDS * ROWS`` minima.  Bands of
   ``ROWS`` minima are hashed to bucket keys; the low ``B`` bits of every
   minimum are packed into the signature.
3. Candidates.  Every member of a bucket is joined to the bucket's smallest
   member - as many edges as members, whatever the bucket's size - and the
   components of those edges are candidate clusters: two classes that share
   any bucket are in one cluster.
4. A cluster is dealt to blocks of a bounded number of members and shingles,
   and every pair of blocks is one unit of work.  There a pair survives if
   the matching low bits, corrected for chance collisions, allow the
   threshold (``MARGIN`` standard errors of slack); survivors are confirmed
   on their full shingle sets.  What leaves a unit is at most one edge per
   member: a forest over the confirmed links.
5. Components of those edges are the result.

With 32 bands of 4 rows a pair at similarity 0.85 shares no band with
probability 5e-11 (0.8: 5e-8); the bit margin adds 3e-7.

Defined cases: null, empty or wordless texts have no shingles and no links.
Rows that repeat an id get the smallest component that any of their texts
has.  A null id takes no part in links and keeps its own row.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.llm.common import WordHashes, cut, kept, mix64, partitions
from driftwood.session import ship_package

BANDS, ROWS, B = 32, 4, 4
#: Standard errors by which the estimate may fall short of the threshold.
MARGIN = 5.0
#: Members and shingles of a block, about: hashing deals them evenly.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of the whole sequence
    if it is shorter; none without words."""
    if not len(words):
        return words
    k = min(n, len(words))
    h = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        h = mix64(h + words[i:len(words) - k + 1 + i] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(h)


def normalised(text: str | None) -> list[bytes]:
    """The words with A-Z in lower case (bytes know no other capitals)."""
    return text.encode().lower().split() if text else []


def seeds(k: int) -> tuple[np.ndarray, np.ndarray]:
    """k odd multipliers and k offsets, from the splitmix64 sequence."""
    x = mix64(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x >> np.uint64(32)).astype(np.uint32)
    return (x[:k] | np.uint32(1))[:, None], x[k:][:, None]


def minima(sets: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Per seed the smallest remixed 32-bit hash over the set."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(mul), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        y = x[None, i:i + 1024] * mul + add
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x85EBCA6B)
        np.minimum(low, y.min(axis=1), out=low)
    return low


def sketch(df: DataFrame, shingle: int, bands: int, rows: int, bits: int) -> DataFrame:
    """(id, text) -> (id, n_shingles, words_key, bits binary, keys
    array<long>); keys and bits are null without words."""
    ship_package(df.sparkSession)
    id_type = df.schema["id"].dataType.simpleString()

    def run(batches):
        kept("near_dup")
        hashes, (mul, add) = WordHashes(), seeds(bands * rows)
        for batch in batches:
            n, key, packed, keys = [], [], [], []
            for text in batch.column(1):
                words = hashes.of(normalised(text.as_py()))
                sets = shingle_hashes(words, shingle)
                n.append(len(sets))
                if not len(sets):
                    key.append(None), packed.append(None), keys.append(None)
                    continue
                place = np.arange(1, len(words) + 1, dtype=np.uint64)
                key.append(b"%d:%d:%d" % (len(words), mix64(words + mix64(place)).sum(),
                                          mix64(words ^ mix64(place + words)).sum()))
                low = minima(sets, mul, add)
                mixed = low * np.uint32(0x9E3779B1)  # its top bits depend on all of the minimum's
                low_bits = (mixed[:, None] >> np.arange(32 - bits, 32, dtype=np.uint32)) & np.uint32(1)
                packed.append(np.packbits(low_bits.astype(np.uint8)).tobytes())
                band = np.zeros(bands, np.uint64)
                for column in low.reshape(bands, rows).T.astype(np.uint64):
                    band = mix64(band + column + np.uint64(0x9E3779B97F4A7C15))
                keys.append(mix64(band + np.arange(bands, dtype=np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()),
                 pa.array(packed, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "n_shingles", "words_key", "bits", "keys"])

    return df.mapInArrow(run, f"id {id_type}, n_shingles long, words_key binary, "
                              "bits binary, keys array<long>")


def least_matches(threshold: Fraction, k: int, bits: int, margin: float) -> int:
    """Matching minima a pair needs: a similarity s makes a low-bit match
    with probability s + (1 - s) / 2**bits."""
    c = 1 / 2 ** bits
    p = float(threshold) + (1 - float(threshold)) * c
    return int(np.floor(k * p - margin * np.sqrt(k * p * (1 - p))))


def likely(a: np.ndarray, b: np.ndarray, bits: int, need: int) -> np.ndarray:
    """Whether the packed signatures of a (n, bytes) and b (m, bytes) have at
    least ``need`` equal groups of ``bits`` bits; bits is 1, 2, 4 or 8 and
    the signature a whole number of 64-bit words."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    lows = np.uint64(sum(1 << i for i in range(0, 64, bits)))
    differ = np.zeros((len(a), len(b)), np.uint16)
    for w in range(a.shape[1]):
        x = a[:, [w]] ^ b[None, :, w]
        k = 1
        while k < bits:
            x |= x >> np.uint64(k)
            k *= 2
        differ += np.bitwise_count(x & lows)
    return a.shape[1] * (64 // bits) - differ >= need


def common(sets: list[np.ndarray], others: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Exact sizes of all intersections of two lists of sets, by products of
    0/1 matrices over the elements that both lists have."""
    out = np.zeros((len(sets), len(others)), np.float64)
    if not sets or not others:
        return out
    shared = np.intersect1d(np.concatenate(sets), np.concatenate(others))
    at = [[np.searchsorted(shared, s[np.isin(s, shared, assume_unique=True)]) for s in x] for x in (sets, others)]
    for lo in range(0, len(shared), columns):
        parts = []
        for side in at:
            m = np.zeros((len(side), min(columns, len(shared) - lo)), np.float32)
            for row, cols in enumerate(side):
                i, j = np.searchsorted(cols, (lo, lo + columns))
                m[row, cols[i:j] - lo] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def compare(left: pd.DataFrame, right: pd.DataFrame | None, need: int, bits: int,
            threshold: Fraction) -> list[tuple]:
    """(id, id) edges that connect what is linked between two blocks, or
    within one if ``right`` is None; at most one per member."""
    whole = left if right is None else pd.concat([left, right])
    ids = whole["id"].to_numpy()
    packed = np.frombuffer(b"".join(whole["bits"]), np.uint8).reshape(len(whole), -1)
    n = len(left)
    maybe = np.zeros((len(whole), len(whole)), bool)
    if right is None:
        maybe[:] = likely(packed, packed, bits, need)
        np.fill_diagonal(maybe, False)
    else:
        maybe[:n, n:] = likely(packed[:n], packed[n:], bits, need)
        maybe[n:, :n] = maybe[:n, n:].T
    used = np.flatnonzero(maybe.any(axis=1))
    if not len(used):
        return []
    sets = [np.frombuffer(whole["shingles"].iloc[i], np.uint64) for i in used]
    size = np.array([len(s) for s in sets], np.float64)
    both = common(sets, sets)
    linked = maybe[np.ix_(used, used)] & (threshold.denominator * both
                                          >= threshold.numerator * (size[:, None] + size[None, :] - both))
    # the smallest position reachable through links, by repeated minima
    top = np.arange(len(used))
    while True:
        new = np.minimum(top, np.where(linked, top[None, :], len(used)).min(axis=1))
        new = new[new]
        if (new == top).all():
            break
        top = new
    return [(ids[used[i]], ids[used[t]]) for i, t in enumerate(top) if i != t]


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, comp) for every end of the (a, b) links, comp being the smallest
    id reachable.  Each round every node takes the smallest label around it
    and then that label's own label; done when nothing changes."""
    both = cut(links.select(F.col("a").alias("id"), F.col("b").alias("to"))
               .union(links.select("b", "a")).where(F.col("id") != F.col("to")).distinct())
    label = cut(both.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("comp")))
    for _ in range(rounds):
        near = (both.join(label.select(F.col("id").alias("to"), F.col("comp").alias("c")), "to")
                .groupBy("id").agg(F.min("c").alias("c")))
        better = label.join(near, "id").select("id", "comp", F.least("comp", "c").alias("c"))
        jump = label.select(F.col("id").alias("c"), F.col("comp").alias("far"))
        new = cut(better.join(jump, "c", "left")
                  .select("id", F.least(F.coalesce("far", "c"), "c").alias("comp"),
                          (F.coalesce("far", "c") < F.col("comp")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        label = new.select("id", "comp")
        if not moved:
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def confirmed(members: DataFrame, clusters: DataFrame, need: int, bits: int, threshold: Fraction,
              block: int = BLOCK, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Edges (a, b) of confirmed links inside clusters.  ``members``:
    (cluster, id, bits, shingles binary); ``clusters``: (cluster, id,
    n_shingles), to size the blocks without the sets."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).where("n > 1")
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("s") / shingles)).cast("int")
    # clusters of one block share units of work, of about a block each
    spark = members.sparkSession
    total = sizes.agg(F.sum("n"), F.sum("s")).first()
    units = int(max(1, (total[0] or 0) / block, (total[1] or 0) / shingles, partitions(spark)))
    unit = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(units)).cast("string")) \
        .otherwise(F.concat_ws(":", F.lit("c"), "cluster", "i", "j"))
    placed = (members.join(sizes.select("cluster", blocks.alias("blocks")), "cluster")
              .withColumn("x", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
              .withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .withColumn("i", F.least("x", "y")).withColumn("j", F.greatest("x", "y"))
              .select(unit.alias("unit"), "cluster", "i", "j", "x", "id", "bits", "shingles"))
    id_type = members.schema["id"].dataType.simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, i, j), group in part.groupby(["cluster", "i", "j"]):
            if i == j:
                out += compare(group, None, need, bits, threshold)
            else:
                left, right = group[group["x"] == i], group[group["x"] == j]
                if len(left) and len(right):
                    out += compare(left, right, need, bits, threshold)
        return pd.DataFrame(out, columns=["a", "b"])

    return placed.groupBy("unit").applyInPandas(run, f"a {id_type}, b {id_type}")


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, text, ...) -> the same with the text's shingle hashes as binary
    in its place."""
    kept = [c for c in texts.columns if c != "text"]
    schema = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in kept) + ", shingles binary"
    texts = texts.select(*kept, "text")

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_hashes(hashes.of(normalised(t.as_py())), shingle).tobytes()
                    for t in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sets, pa.binary())],
                                             names=[*kept, "shingles"])

    return texts.mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 5, threshold: float | str | Fraction = "0.8",
                    bands: int = BANDS, rows: int = ROWS, bits: int = B,
                    margin: float = MARGIN) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest linked id, its own
    included) and kept (it is that id).  ``bands * rows * bits`` must be a
    multiple of 64 and bits 1, 2, 4 or 8."""
    threshold = threshold if isinstance(threshold, Fraction) else Fraction(str(threshold))
    need = least_matches(threshold, bands * rows, bits, margin)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sketched = cut(sketch(src, shingle, bands, rows, bits))
    worded = sketched.where(F.col("keys").isNotNull() & F.col("id").isNotNull())
    # 1. equal words: one row per class
    classes = cut(worded.groupBy("words_key").agg(
        F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"),
        F.first("bits").alias("bits"), F.first("keys").alias("keys")))
    # 3. every member of a bucket beside its smallest
    heads = classes.select("id", F.explode("keys").alias("key"))
    buckets = heads.groupBy("key").agg(F.min("id").alias("centre"), F.count("*").alias("n")).where("n > 1")
    # a member's centres (one per band at most) hang together through it: an
    # edge to the smallest, and edges from that to the others, say the same
    own = heads.join(buckets, "key").groupBy("id").agg(F.array_distinct(F.collect_list("centre")).alias("c"))
    least = F.array_min("c")
    edges = own.select(F.explode(F.concat(
        F.array(F.struct(least.alias("a"), F.col("id").alias("b"))),
        F.transform("c", lambda c: F.struct(least.alias("a"), c.alias("b"))))).alias("e")) \
        .select("e.a", "e.b").where("a <> b").distinct()
    clusters = components(edges).withColumnRenamed("comp", "cluster")
    # 4. the texts of clustered classes only; an id with several texts has each of them
    chosen = cut(classes.join(clusters, "id").select("id", "cluster", "n_shingles", "bits"))
    texts = src.join(chosen.select("id", "cluster", "bits"), "id").select("id", "cluster", "bits", "text")
    label = components(confirmed(shingle_sets(texts, shingle), chosen.drop("bits"), need, bits, threshold))
    # back to the members of the classes, then to rows
    own = (worded.select("id", "words_key")
           .join(classes.select(F.col("id").alias("head"), "words_key"), "words_key")
           .join(label.select(F.col("id").alias("head"), "comp"), "head", "left")
           .groupBy("id").agg(F.min(F.coalesce("comp", "head")).alias("comp")))
    component = F.coalesce("comp", "id")
    return (sketched.select("id", "n_shingles").join(own, "id", "left")
            .select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
                    F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")))


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)]) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN c ON s.doc_id = c.doc_id
"""
