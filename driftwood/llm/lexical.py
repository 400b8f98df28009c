"""Ranked lexical search with pair-bound MaxScore.

The best ``k`` documents per query by a sum of term impacts; scores are exact
integers (see ``impacts``).  Ties go to the smaller id.

1. The terms of a pack of queries (at most about ``PACK`` with repeats; further
   packs are searched after one another) go to every task as a dictionary.
   Each document becomes its length and the counts of those terms.
2. Index.  Documents are put into blocks of ``BLOCK`` at most, where they are:
   no shuffle.  A block has the posting list of each term (documents and
   impacts) and, for the pairs of terms that queries pair up, the list of the
   documents that have both and their *joint maximum impact*.  A query's terms
   are paired by weight, rarest first: rare terms hardly ever meet, so a pair's
   joint maximum is far below the sum of its two maxima.
3. Search.  A pair adds at most ``max(joint maximum, either maximum)`` to a
   document, a single term its maximum.  Where the sum of these bounds is below
   the ``k``-th best score known, the block is skipped.  Else terms are taken
   from the smallest maximum up, and a pair's bound takes the place of its two
   maxima as soon as both are in: those that together stay below the known
   score are inessential.  Only documents of the others are scored, and dropped
   as soon as what is left (less for those not on a pair's list) can't lift
   them.  Known scores come from the first block of every task,
   searched before the rest, and from the blocks that a task has done.
4. Each task hands on at most ``k`` documents per query; Spark ranks them.

Bounds only decide what is skipped (strictly below the known score), never the
result.  Nothing but the queries, document frequencies of their terms and one
score per query passes through the driver, all bounded by the pack.

Defined cases: null and termless texts are no documents and no queries.
Queries with one id and one text are one query, with one id and different
texts several, each ranked for itself.  Documents without an id come after all
others among equal scores; rows with one id are separate documents.  Only
scores above 0 are returned.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwood.llm.common import cut
from driftwood.session import ship_package

#: A term: ASCII letters and digits and everything beyond ASCII.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Terms of the queries that are searched at once, with repeats, about.
PACK = 500_000
#: Documents and postings of a block.
BLOCK, POSTINGS = 4_096, 500_000


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text as UTF-8, A-Z lower-cased."""
    return TERM.findall(text.encode().lower()) if text else []


@dataclass
class Units:
    """The pairs and single terms of a pack's queries, flat: query q has the
    units ``start[q]:start[q + 1]``; ``b`` is -1 for a single term."""

    start: np.ndarray
    a: np.ndarray
    b: np.ndarray
    times_a: np.ndarray
    times_b: np.ndarray
    pair: np.ndarray  # place in ``pairs``, -1 for a single term
    pairs: list = field(default_factory=list)


def pair_up(queries: list[dict[int, int]], weight: np.ndarray) -> Units:
    """Pair the terms of each query (term -> times), the weightiest first."""
    start, flat, place = [0], [], {}
    for q in queries:
        order = sorted(q, key=lambda t: (-weight[t], t))
        for a, b in zip(order[::2], order[1::2] + [-1] * (len(order) % 2)):
            pair = -1 if b < 0 else place.setdefault((a, b), len(place))
            flat.append((a, b, q[a], q.get(b, 0), pair))
        start.append(len(flat))
    columns = np.array(flat, np.int64).reshape(-1, 5).T
    return Units(np.array(start), *columns, pairs=list(place))


def impacts(tf: np.ndarray, weight: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a document's score, once per time the query has it."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


NONE = np.zeros(0, np.int64)


def held(docs: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which of ``found`` are in the sorted ``docs``."""
    if not len(docs):
        return np.zeros(len(found), bool)
    return docs[np.minimum(np.searchsorted(docs, found), len(docs) - 1)] == found


class Block:
    """Posting lists of a block of documents, with the joint maxima of pairs.
    Documents are numbered in the order of their ids."""

    def __init__(self, n_docs: int, docs: np.ndarray, terms: np.ndarray, impact: np.ndarray, n_terms: int):
        order = np.lexsort((docs, terms))
        self.n_docs, self.docs, self.impact = n_docs, docs[order], impact[order]
        self.start = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.highest = np.zeros(n_terms, np.int64)
        has = np.flatnonzero(np.diff(self.start))
        if len(has):
            self.highest[has] = np.maximum.reduceat(self.impact, self.start[has])
        self.both, self.joint = {}, np.zeros(0, np.int64)

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.start[term], self.start[term + 1])
        return self.docs[at], self.impact[at]

    def intersect(self, pairs: list) -> None:
        """The documents that have both terms of a pair, and the highest sum
        of their impacts."""
        self.joint = np.zeros(len(pairs), np.int64)
        for i, (a, b) in enumerate(pairs):
            if self.highest[a] and self.highest[b]:
                (docs_a, imp_a), (docs_b, imp_b) = self.postings(a), self.postings(b)
                both, at_a, at_b = np.intersect1d(docs_a, docs_b, assume_unique=True, return_indices=True)
                if len(both):
                    self.both[i] = both
                    self.joint[i] = (imp_a[at_a] + imp_b[at_b]).max()

    def bounds(self, u: Units) -> np.ndarray:
        """What each unit adds to any document of the block at most."""
        high_a = self.highest[u.a]
        high_b = np.where(u.b < 0, 0, self.highest[u.b])
        joint = np.maximum(high_a, high_b)
        if len(self.joint):
            joint = np.maximum(joint, np.where(u.pair < 0, 0, self.joint[u.pair]))
        shared = np.minimum(u.times_a, u.times_b)  # what one has beyond the other is bounded for itself
        return shared * joint + (u.times_a - shared) * high_a + (u.times_b - shared) * high_b

    def search(self, u: Units, bound: np.ndarray, q: int, least: int, k: int,
               stats: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of the block's best ``k`` for query ``q`` among
        those that score ``least`` or more, best first."""
        terms = []  # (most that it adds, term, times, unit)
        for i in range(u.start[q], u.start[q + 1]):
            terms += [(times * self.highest[t], t, times, i) for t, times in (
                (u.a[i], u.times_a[i]), (u.b[i], u.times_b[i])) if times]
        terms.sort(key=lambda x: x[0])
        upto, alone, total = [], {}, 0  # what the terms up to each add together
        for most, _, _, i in terms:
            total += bound[i] - alone[i] if i in alone else most
            alone[i] = most  # the larger of two, as they come in order
            upto.append(int(total))
        first = int(np.searchsorted(upto, least))  # the terms before are inessential
        score = np.zeros(self.n_docs, np.int64)
        for _, t, times, _ in terms[first:]:
            docs, impact = self.postings(t)
            score[docs] += times * impact
        found = np.flatnonzero(score)
        if stats is not None:
            stats["scored"] += len(found)
        met = Counter(i for _, _, _, i in terms[:first])
        for j in range(first - 1, -1, -1):
            most, t, times, i = terms[j]
            gain = upto[j]
            if met[i] == 2:  # both are left: who lacks one gains the larger at most
                gain = np.where(held(self.both.get(u.pair[i], NONE), found), gain, gain - bound[i] + most)
            met[i] -= 1
            found = found[score[found] + gain >= least]
            if not len(found):
                break
            docs, impact = self.postings(t)
            has = held(docs, found)
            score[found[has]] += times * impact[np.searchsorted(docs, found[has])]
        found = found[score[found] >= max(least, 1)]
        best = np.lexsort((found, -score[found]))[:k]
        return found[best], score[found[best]]


def vectors(docs: DataFrame, words: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, tfs) of the (id, text) rows that have a term: their
    number of terms, and how often they have those of ``words``."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        number = shared.value.get
        for batch in batches:
            rows, sizes, terms, tfs = [], [], [], []
            for row, text in enumerate(batch.column(1)):
                found = terms_of(text.as_py())
                if found:
                    counts = Counter(map(number, found))
                    counts.pop(None, None)
                    rows.append(row), sizes.append(len(found))
                    terms.append(list(counts)), tfs.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(sizes, pa.int64()),
                 pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                names=["id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, f"id {kind}, n long, terms array<int>, tfs array<long>")


def blocks_of(batches, block: int, postings: int):
    """Vectors cut into tables of at most ``block`` documents; one that
    reaches ``postings`` postings is the last of its table."""
    held, rows, size = [], 0, 0
    for batch in batches:
        ends, at = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)), 0
        while at < batch.num_rows:
            seen = int(ends[at - 1]) if at else 0
            full = int(np.searchsorted(ends, seen + postings - size)) + 1
            stop = min(at + block - rows, full, batch.num_rows)
            held.append(batch.slice(at, stop - at))
            rows, size, at = rows + stop - at, size + int(ends[stop - 1]) - seen, stop
            if rows >= block or size >= postings:
                yield pa.Table.from_batches(held)
                held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def index(found: DataFrame, n_docs: int, length: int, weight: np.ndarray, block: int, postings: int) -> DataFrame:
    """(block, ids, docs, terms, impacts): a row per block of the vectors,
    its documents in the order of their ids and its postings."""
    shared = found.sparkSession.sparkContext.broadcast(weight)
    kind = found.schema["id"].dataType.simpleString()

    def run(batches):
        for number, part in enumerate(blocks_of(batches, block, postings)):
            part = part.combine_chunks()
            part = part.take(pc.array_sort_indices(part.column("id").combine_chunks(), null_placement="at_end"))
            sizes = pc.list_value_length(part.column("terms")).to_numpy()
            m = np.array([75 + 25 * n * n_docs // length for n in part.column("n").to_pylist()], np.int64)
            docs = np.repeat(np.arange(part.num_rows), sizes)
            terms = pc.list_flatten(part.column("terms")).to_numpy()
            tf = pc.list_flatten(part.column("tfs")).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32()),
                 pa.array([part.column("id").to_pylist()], pa.list_(part.column("id").type)),
                 pa.array([docs.astype(np.int32)], pa.list_(pa.int32())),
                 pa.array([terms.astype(np.int32)], pa.list_(pa.int32())),
                 pa.array([impacts(tf, shared.value[terms], m[docs])], pa.list_(pa.int64()))],
                names=["block", "ids", "docs", "terms", "impacts"])

    return found.mapInArrow(run, f"block int, ids array<{kind}>, docs array<int>, terms array<int>, impacts array<long>")


def search_blocks(blocks: DataFrame, units: Units, n_terms: int, least: np.ndarray, k: int) -> DataFrame:
    """(query, id, score): the best of each task's blocks, at most ``k`` per
    query, of those that score ``least`` or more."""
    shared = blocks.sparkSession.sparkContext.broadcast((units, least))
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        u, known = shared.value
        known, best = known.copy(), {}
        id_type = None
        for batch in batches:
            id_type = batch.column(1).type.value_type
            for row in range(batch.num_rows):
                ids, docs, terms, impact = (batch.column(c)[row].values for c in range(1, 5))
                part = Block(len(ids), *(x.to_numpy() for x in (docs, terms, impact)), n_terms)
                part.intersect(u.pairs)
                bound = part.bounds(u)
                total = np.r_[0, np.cumsum(bound)]
                total = total[u.start[1:]] - total[u.start[:-1]]
                for q in np.flatnonzero((total >= known) & (total > 0)):
                    at, score = part.search(u, bound, q, int(known[q]), k)
                    if len(at):
                        new = list(zip(score.tolist(), ids.take(pa.array(at)).to_pylist()))
                        mine = best[q] = sorted(best.get(q, []) + new,
                                                key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))[:k]
                        if len(mine) == k:
                            known[q] = max(known[q], mine[-1][0])
        if best:
            flat = [(q, id_, score) for q, mine in best.items() for score, id_ in mine]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.int32()),
                                              pa.array([f[1] for f in flat], id_type),
                                              pa.array([f[2] for f in flat], pa.int64())], names=["query", "id", "score"])

    return blocks.mapInArrow(run, f"query int, id {kind}, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_pack(docs: DataFrame, texts: list[str], k: int, block: int, postings: int) -> DataFrame | None:
    """(query, rank, id, score), query being the place in ``texts``."""
    words: dict[bytes, int] = {}
    queries = [dict(Counter(words.setdefault(t, len(words)) for t in terms_of(text))) for text in texts]
    if not words:
        return None
    found = cut(vectors(docs, words))
    n_docs, length = found.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    weight = np.full(len(words), math.floor(1000 * math.log(2 * n_docs + 2)), np.int64)
    for term, df in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    units = pair_up(queries, weight)
    blocks = cut(index(found, n_docs, length, weight, block, postings))
    least = np.zeros(len(queries), np.int64)
    early = cut(best_of(search_blocks(blocks.where("block = 0"), units, len(words), least, k), k))
    for q, score in early.where(F.col("rank") == k).select("query", "score").collect():
        least[q] = score
    late = search_blocks(blocks.where("block > 0"), units, len(words), least, k)
    return best_of(early.select("query", "id", "score").unionByName(late), k)


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           query_id: str = "item_id", query_text: str = "text", k: int = 20, pack: int = PACK,
           block: int = BLOCK, postings: int = POSTINGS) -> DataFrame:
    """(query id, rank, id, score): the best ``k`` documents of each query."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    text = F.col(query_text).cast("string")
    asked = cut(queries.select(F.col(query_id).alias("qid"), text.alias("text"))
                .where(F.col("text").isNotNull()).distinct())
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    packs = max(1, math.ceil(size / 4 / pack))  # a term and its space take about four characters or more
    every = None
    for p in range(packs):
        texts = (asked.where(F.pmod(F.xxhash64("qid", "text"), F.lit(packs)) == p)
                 .select("qid", "text").collect())  # bounded by the pack
        got = search_pack(rows, [r["text"] for r in texts], k, block, postings)
        if got is None:
            continue
        kind = asked.schema["qid"].dataType
        names = spark.createDataFrame([(i, r["qid"]) for i, r in enumerate(texts)],
                                      T.StructType([T.StructField("query", T.IntegerType()), T.StructField("qid", kind)]))
        got = got.join(names, "query").select(F.col("qid").alias(query_id), "rank", F.col("id").alias(id_col), "score")
        got = cut(got) if packs > 1 else got
        every = got if every is None else every.unionByName(got)
    if every is None:
        return spark.createDataFrame([], T.StructType([
            T.StructField(query_id, queries.schema[query_id].dataType), T.StructField("rank", T.IntegerType()),
            T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.LongType())]))
    return every


SEARCH_SQL = r"""
WITH q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
qt AS (SELECT item_id, term, COUNT(*) AS times FROM q GROUP BY item_id, term),
d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
dn AS (SELECT doc_id, COUNT(*)::BIGINT AS n FROM d GROUP BY doc_id),
totals AS (SELECT COUNT(*)::BIGINT AS big_n, SUM(n)::BIGINT AS l FROM dn),
tf AS (SELECT doc_id, term, COUNT(*)::BIGINT AS tf FROM d GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * COUNT(*) + 1)))::BIGINT AS w
      FROM tf, totals GROUP BY term, big_n),
m AS (SELECT doc_id, 100 - 25 + (25 * n * big_n) // l AS m FROM dn, totals),
s AS (
  SELECT item_id, tf.doc_id, SUM(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM qt JOIN tf ON qt.term = tf.term JOIN w ON w.term = tf.term JOIN m ON m.doc_id = tf.doc_id
  GROUP BY item_id, tf.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20
"""
