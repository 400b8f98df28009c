"""Approximate nearest neighbours by multi-index hashing.

Codes.  Vectors are scaled to length one, centred, and turned by ``TURNS``
rotations learned on a bounded sample (iterative quantisation: alternate
signs and the orthogonal matrix that fits them best); the signs of a turned
vector are its bits, ``TURNS`` times the dimension of them.

Index.  A code is split into 8-bit substrings.  In a block of rows every
substring value lists the rows that have it.  Two codes within Hamming radius
r agree within ``r // substrings`` bits in at least one substring, so probing
each substring's ball of that size retrieves every code within r; what was
retrieved is cut to the radius and reranked by the exact cosine in double
precision.

Radius.  On the sample, the distance that ``KEEP`` of the true neighbours of
sampled queries do not exceed.  All rows lie denser than a sample, so real
neighbours are nearer than that.  A query with fewer than k codes within the
radius of a block widens its own radius there until it has k, so k neighbours
are found whenever there are as many rows.

Spark side: every row is indexed.  Rows are dealt to about sqrt(n) / 16
blocks by a hash of the id and each block is one group; the stated queries go
to every block in packs of ``PACK``.  A block returns k rows a query, and a
window takes the best k of all blocks.  At n rows a block holds 16 sqrt(n) of
them, and queries are copied sqrt(n) / 16 times, so neither memory nor
shuffle grows faster than n * sqrt(n) / 800.  Equal vectors, however many, are
spread over all blocks by their ids.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do null ids; rows that repeat an id count once,
as the smallest of their vectors; vectors whose length differs from the most
frequent one take no part.  Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.llm.common import cut
from driftwood.session import ship_package

#: Rows the rotations and the radius are learned from, and sampled queries.
SAMPLE, PROBES = 4_096, 256
TURNS, ROUNDS, KEEP = 2, 30, 0.97
#: Queries that are sent together.
PACK = 512


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn_rotations(x: np.ndarray, turns: int = TURNS, rounds: int = ROUNDS, seed: int = 7) -> tuple:
    """(mean, dimension x bits matrix) fitted to unit vectors."""
    mean = x.mean(axis=0)
    x = x - mean
    parts, rng = [], np.random.default_rng(seed)
    for _ in range(turns):
        r = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
            r = (u @ vt).T
        parts.append(r)
    return mean, np.hstack(parts)


def codes(x: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Packed bits of unit vectors, 8 to a byte."""
    return np.packbits((x - mean) @ turn >= 0, axis=1)


ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Substring values within each distance of 0.
BALLS = [np.flatnonzero(ONES <= d).astype(np.uint8) for d in range(9)]


class MultiIndex:
    """Codes of one block, listed by the value of every substring."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed
        self.lists = []
        for column in packed.T:
            order = np.argsort(column, kind="stable")
            self.lists.append((order, np.searchsorted(column[order], np.arange(257))))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within ``radius`` of ``code``."""
        reach = min(8, radius // self.packed.shape[1])
        hit = np.zeros(len(self.packed), bool)
        for own, (order, start) in zip(code, self.lists):
            for value in (BALLS[reach] ^ own).tolist():
                hit[order[start[value]:start[value + 1]]] = True
            if hit.all():
                break
        rows = np.flatnonzero(hit)
        return rows[ONES[self.packed[rows] ^ code].sum(axis=1, dtype=np.int64) <= radius]


def learn_radius(x: np.ndarray, packed: np.ndarray, k: int, probes: int = PROBES, keep: float = KEEP) -> int:
    """The code distance that ``keep`` of the true k neighbours of the first
    ``probes`` rows do not exceed."""
    if len(x) < 2:
        return 0
    near = []
    for i in range(min(probes, len(x))):
        score = x @ x[i]
        score[i] = -np.inf
        best = np.argpartition(-score, min(k, len(x) - 1) - 1)[:min(k, len(x) - 1)]
        near.append(ONES[packed[best] ^ packed[i]].sum(axis=1, dtype=np.int64))
    return int(np.quantile(np.concatenate(near), keep))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of the vectors that take part, one per id."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = df.select(F.col(id_col).alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(True))
        & F.exists("v", lambda x: x != 0))
    return ok.groupBy("id").agg(F.min("v").alias("v"))


def nearest(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id",
            vector_col: str = "embedding", turns: int = TURNS, keep: float = KEEP) -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows found for every row
    that ``is_query`` selects, itself not among them."""
    spark = df.sparkSession
    ship_package(spark)
    rows = usable(df, id_col, vector_col)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    out = f"query_id {rows.schema['id'].dataType.simpleString()}, vec_id {rows.schema['id'].dataType.simpleString()}, score double"
    if not sizes:
        return spark.createDataFrame([], out.replace(", vec_id", ", rank int, vec_id"))
    rows = cut(rows.where(F.size("v") == sizes[0]["d"]))
    n, dim = sizes[0]["count"], sizes[0]["d"]
    sample = rows.orderBy(F.md5(F.col("id").cast("string")), "id").limit(SAMPLE).select("v").collect()
    x = unit(np.array([r["v"] for r in sample], np.float64))
    mean, turn = learn_rotations(x, turns)
    radius = learn_radius(x, codes(x, mean, turn), k, keep=keep)
    blocks = max(1, round(n ** 0.5 / 16))
    # equal work for every block: the hashed ids are dealt to the blocks
    placed = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    queries = rows.withColumnRenamed("id", id_col).where(is_query).withColumnRenamed(id_col, "id")
    packs = queries.select("id", "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(1, n // PACK // 50))).alias("pack")) \
        .groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("q"))
    sent = packs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) \
        .select("block", "q")

    def run(key: tuple, data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(data) or not len(asked):
            return pd.DataFrame([], columns=names)
        ids = data["id"].to_numpy()
        v = np.array(data["v"].tolist(), np.float64)
        length = np.linalg.norm(v, axis=1)
        scaled = v / length[:, None]
        index = MultiIndex(codes(scaled, mean, turn))
        bits = turn.shape[1]
        found = []
        for pack in asked["q"]:
            qv = np.array([q["v"] for q in pack], np.float64)
            ql = np.linalg.norm(qv, axis=1)
            qc = codes(qv / ql[:, None], mean, turn)
            for q, own, own_length, code in zip(pack, qv, ql, qc):
                r = radius
                while True:
                    near = index.within(code, r)
                    near = near[ids[near] != q["id"]]
                    if len(near) >= k or r >= bits:
                        break
                    r = min(bits, r + max(1, bits // 16))
                # float products rank; the few best are then scored one by one
                score = v[near] @ own / (length[near] * own_length)
                best = near[np.lexsort((ids[near], -np.round(score, 12)))[:k + 3]]
                found += [(q["id"], i, s) for i, s in zip(ids[best], (v[best] * own).sum(axis=1) / (length[best] * own_length))]
        return pd.DataFrame(found, columns=names)

    some = placed.groupBy("block").cogroup(sent.groupBy("block")).applyInPandas(run, out)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "score")).alias("score")))
