"""Removal of word windows that have occurred before.

A window is ``WINDOW`` consecutive words of one document; it is repeated if
the same words also start earlier (smaller id, or earlier in the document).

1. Anchors.  A window's anchor is its smallest ``GRAM``-word hash (the first
   of equals).  Equal windows have equal anchors, so windows with the same
   anchor form runs; each run is one *span*: the words its windows cover.
   There are about 2 spans for every ``WINDOW - GRAM + 2`` words.
2. Equal spans: all but the first are repeated as a whole.  This is decided
   within a task's batch first, so that what is shared by very many documents
   leaves a task once.
3. An anchor with one kind of span can't hold a repeated window beyond those.
4. First spans of an anchor that has several go to the *reference shard* of
   the anchor.  A shard streams its spans in document order through a suffix
   automaton of the spans before: the matching statistic at each word says
   how long a match ends there, and windows wholly inside one are repeated.
5. Anchors with more than ``CROWD`` different spans (the edges of a passage
   that very many documents share) would make a shard large.  Their windows
   are compared one by one instead, by an aggregation over window hashes
   that combines map-side, so no task holds a crowd.

Shards are dealt by content instead of being broadcast to every document:
the reference is the whole corpus, which has no size bound, and only the
shard of a window's own anchor can hold an equal window.

Defined cases: null texts have no words.  Rows with one id and different
texts are documents that follow one another in the order of a hash of the
text; rows with one id and one text are the same document, and keep and lose
the same words.  Rows without an id keep all their words and are no reference
for others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwood.llm.common import WORD_RE, WordHashes, cut, kept, mix64, partitions, release, words_of
from driftwood.session import ship_package

WINDOW, GRAM = 20, 6
#: Different spans of one anchor that a shard takes at most.
CROWD = 256
#: Words of a shard, about: the number of shards grows with the input.
SHARD_WORDS = 200_000


BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
#: Low bits of a window's sort key that hold a place in the document.
PLACE_BITS = 28


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


def range_hashes(words: np.ndarray, powers: Powers):
    """A function (starts, stops) -> hashes of those word ranges, from prefix
    sums of word hashes times powers (modulo 2**64)."""
    up, down = powers.get(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:len(words)], out=sums[1:])
    return lambda start, stop: mix64((sums[stop] - sums[start]) * down[start])


def runs(words: np.ndarray, window: int, gram: int, powers: Powers) -> tuple:
    """(anchor, span hash, first window, last window) of every run of windows
    that share one anchor place."""
    if len(words) >= 1 << PLACE_BITS:
        raise ValueError(f"a document of more than {1 << PLACE_BITS} words")
    hashed = range_hashes(words, powers)
    at = np.arange(len(words) - gram + 1)
    grams = hashed(at, at + gram)
    low = np.uint64((1 << PLACE_BITS) - 1)
    # smallest (hash, place) of every width grams in a row, by doubling
    least, have, width = (grams & ~low) | at.astype(np.uint64), 1, window - gram + 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    place = (least & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], len(place)] - 1
    return grams[place[first]], hashed(first, last + window), first, last


class SuffixAutomaton:
    """Suffix automaton of a growing set of word sequences; state 0 is the
    empty sequence."""

    def __init__(self):
        self.next, self.link, self.size = [{}], [-1], [0]

    def extend(self, last: int, word: int) -> int:
        """Append ``word`` to the sequence that ended in state ``last``."""
        nxt, link, size = self.next, self.link, self.size
        if word in nxt[last]:
            q = nxt[last][word]
            return q if size[q] == size[last] + 1 else self._split(last, word, q)
        cur = len(size)
        nxt.append({}), size.append(size[last] + 1), link.append(0)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[cur] = q if size[q] == size[p] + 1 else self._split(p, word, q)
        return cur

    def _split(self, p: int, word: int, q: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        clone = len(size)
        nxt.append(dict(nxt[q])), size.append(size[p] + 1), link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = clone
            p = link[p]
        return clone

    def matching(self, words: list) -> list[int]:
        """Per word the length of the longest match that ends there."""
        nxt, link, size = self.next, self.link, self.size
        state, n, out = 0, 0, []
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                n = size[state]
            if w in nxt[state]:
                state = nxt[state][w]
                n += 1
            out.append(n)
        return out


def document_ranks(ids: pa.Array, h: pa.Array) -> np.ndarray:
    """Places of the rows in the order of (id, h); equal documents share one."""
    rows = pa.table([ids, h], names=["id", "h"])
    order = pc.sort_indices(rows, sort_keys=[("id", "ascending"), ("h", "ascending")])
    rows = rows.take(order)
    new = np.zeros(len(rows), bool)
    for c in rows.columns:
        c = c.combine_chunks()
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    rank = np.empty(len(rows), np.int64)
    rank[order.to_numpy()] = np.cumsum(new)
    return rank


def first_of_equal(anchor: np.ndarray, span: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple:
    """Of the spans of one batch: which are the first of those equal to them,
    and which come later for sure (a repeated row is neither)."""
    order = np.lexsort((first, doc, span, anchor))
    key = [x[order] for x in (anchor, span, doc, first)]
    differ = lambda xs: np.r_[True, np.any([x[1:] != x[:-1] for x in xs], axis=0)]
    head = differ(key[:2])
    place = np.flatnonzero(head)[np.cumsum(head) - 1]  # of the first of its equals
    later = (key[2] != key[2][place]) | (key[3] != key[3][place])
    one, sure = np.zeros(len(order), bool), np.zeros(len(order), bool)
    one[order[head]], sure[order] = True, later
    return one, sure


def spans(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, h, key, span, first, last, sure): the runs of every text.  Of equal
    runs in a batch only the first goes on under its anchor as ``key``; the
    others are repeated whatever the other batches hold (``sure``) and go
    anywhere, so a passage that very many documents share is no hot key."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches):
        kept("repeats")
        hashes, powers = WordHashes(), Powers()
        for batch in batches:
            at, cols = [], ([], [], [], [])
            for row, text in enumerate(batch.column(2)):
                words = hashes.of(words_of(text.as_py()))
                if len(words) < window:
                    continue
                found = runs(words, window, gram, powers)
                at.append(np.full(len(found[0]), row))
                for c, x in zip(cols, found):
                    c.append(x)
            if not at:
                continue
            rows = np.concatenate(at)
            anchor, span, first, last = map(np.concatenate, cols)
            one, sure = first_of_equal(anchor, span, document_ranks(batch.column(0), batch.column(1))[rows], first)
            go = np.flatnonzero(one | sure)
            rows, anchor, span, first, last, sure = (x[go] for x in (rows, anchor, span, first, last, sure))
            spread = mix64(span + np.arange(len(span), dtype=np.uint64))
            rows = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows),
                 pa.array(np.where(sure, spread, anchor).view(np.int64)), pa.array(span.view(np.int64)),
                 pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(sure)],
                names=["id", "h", "key", "span", "first", "last", "sure"])

    return docs.mapInArrow(run, f"id {id_type}, h int, key long, span long, first int, last int, sure boolean")


def span_words(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The word hashes of the wanted (id, h, anchor, first, last) spans."""
    per_doc = wanted.groupBy("id", "h").agg(F.collect_list(F.struct("anchor", "crowd", "first", "last")).alias("spans"))
    joined = docs.join(per_doc, ["id", "h"]).select("id", "h", "text", "spans")
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for row in range(batch.num_rows):
                words = hashes.of(words_of(batch.column(2)[row].as_py())).view(np.int64)
                got = batch.column(3)[row].as_py()
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([batch.column(c)[row].as_py()] * len(got), batch.column(c).type) for c in (0, 1)),
                     pa.array([s["anchor"] for s in got], pa.int64()),
                     pa.array([s["crowd"] for s in got], pa.bool_()),
                     pa.array([s["first"] for s in got], pa.int32()),
                     pa.array([s["last"] for s in got], pa.int32()),
                     pa.array([words[s["first"]:s["last"] + window] for s in got], pa.list_(pa.int64()))],
                    names=["id", "h", "anchor", "crowd", "first", "last", "words"])

    return joined.mapInArrow(run, f"id {id_type}, h int, anchor long, crowd boolean, first int, last int, "
                                  "words array<long>")


def shard_repeats(part: DataFrame, window: int, n_shards: int) -> DataFrame:
    """(id, h, first, last) runs of repeated windows, per reference shard."""
    id_type = part.schema["id"].dataType.simpleString()

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        out = []
        place = ["anchor", "id", "h", "first"]
        for _, group in shard.drop_duplicates(place).sort_values(place).groupby("anchor", sort=False):
            seen = SuffixAutomaton()  # only spans of one anchor share windows
            for id_, h, first, words in zip(group["id"], group["h"], group["first"], group["words"]):
                words = words.tolist()
                for end, n in enumerate(seen.matching(words)):
                    if n >= window:
                        out.append((id_, h, first + end - window + 1))
                state = 0
                for w in words:
                    state = seen.extend(state, w)
        at = pd.DataFrame(out, columns=["id", "h", "first"])
        return at.assign(last=at["first"]).astype({"first": "int32", "last": "int32"})

    return (part.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(n_shards)))
            .groupBy("shard").applyInPandas(run, f"id {id_type}, h int, first int, last int"))


def crowd_repeats(part: DataFrame, window: int) -> DataFrame:
    """The same by window hashes: a window is repeated unless it is the
    first place of its hash."""
    n = F.size("words") - window
    rows = part.select("id", "h", "first", F.posexplode(F.transform(
        F.sequence(F.lit(0), n), lambda i: F.xxhash64(F.slice("words", i + 1, window)))).alias("k", "w")) \
        .select("w", F.struct("id", "h", (F.col("first") + F.col("k")).alias("at")).alias("here"))
    firsts = rows.groupBy("w").agg(F.min("here").alias("one"), F.count("*").alias("n")).where("n > 1")
    return (rows.join(firsts, "w").where(F.col("here") != F.col("one"))
            .select("here.id", "here.h", F.col("here.at").alias("first"), F.col("here.at").alias("last")))


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM,
                     crowd: int = CROWD) -> DataFrame:
    """(id, h, first, last): runs of repeated windows of the (id, h, text)
    rows, h being a hash of the text."""
    spark = docs.sparkSession
    ship_package(spark)
    # one exchange, by anchor, serves both windows
    equal = Window.partitionBy("key", "span").orderBy("id", "h", "first")
    placed = spans(docs, window, gram).repartition(partitions(spark), "key").select(
        "*", F.rank().over(equal).alias("rank"), F.row_number().over(equal).alias("row"))
    one = (F.col("rank") == 1) & (F.col("row") == 1) & ~F.col("sure")
    counted = placed.select("*", F.count(F.when(one, 1)).over(Window.partitionBy("key")).alias("kinds"))
    whole = F.col("sure") | (F.col("rank") > 1)
    found = cut(counted.where(whole | (one & (F.col("kinds") > 1))).select(
        "id", "h", F.when(~whole, F.col("key")).alias("anchor"), "first", "last", (F.col("kinds") > crowd).alias("crowd")))
    release(spark)
    repeated = found.where("anchor is null").select("id", "h", "first", "last")
    wanted = found.where("anchor is not null")
    size = wanted.where("not crowd").agg(F.sum(F.col("last") - F.col("first") + window)).first()[0] or 0
    parts = cut(span_words(docs, wanted, window))
    release(spark)
    n_shards = max(4 * partitions(spark), size // SHARD_WORDS + 1)
    return (repeated.unionByName(shard_repeats(parts.where("not crowd"), window, n_shards))
            .unionByName(crowd_repeats(parts.where("crowd"), window)))


def strip_words(text: str, covered: np.ndarray) -> str:
    """The text without its covered words: from each run's first word to the
    next kept word; unchanged if none is covered."""
    if not covered.any():
        return text
    at = [m.span() for m in WORD_RE.finditer(text)]
    out, keep_from, i = [], 0, 0
    while i < len(at):
        if covered[i]:
            out.append(text[keep_from:at[i][0]])
            while i < len(at) and covered[i]:
                i += 1
            keep_from = at[i][0] if i < len(at) else len(text)
        else:
            i += 1
    return ("".join(out) + text[keep_from:]).rstrip()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """``docs`` plus a struct ``__cleaned``: the text without the words of
    repeated windows, n_words, n_removed, and the SHA-256 of the kept words
    joined by a space."""
    text = F.col(text_col).cast("string")
    keyed = docs.select(F.col(id_col).alias("id"), F.hash(text).alias("h"), text.alias("text"))
    found = repeated_windows(keyed.where("id is not null"), window, gram, crowd)
    per_doc = found.groupBy(F.col("id").alias("__dw_id"), F.col("h").alias("__dw_h")).agg(F.collect_list(
        F.shiftleft(F.col("first").cast("long"), 32).bitwiseOR(F.col("last").cast("long"))).alias("__dw_runs"))
    joined = docs.join(per_doc, (docs[id_col] == F.col("__dw_id")) & (F.hash(text) == F.col("__dw_h")), "left") \
        .drop("__dw_id", "__dw_h")

    def run(texts, found):
        out = []
        for text, runs_ in zip(texts, found):
            words = words_of(text)
            covered = np.zeros(len(words) + 1, np.int64)
            for r in () if runs_ is None else runs_:
                first, stop = int(r) >> 32, (int(r) & 0xFFFFFFFF) + window
                if stop <= len(words):
                    covered[first] += 1
                    covered[stop] -= 1
            covered = np.cumsum(covered)[:-1] > 0
            kept = [w for w, c in zip(words, covered) if not c]
            out.append((text and strip_words(text, covered), len(words), len(words) - len(kept),
                        hashlib.sha256(b" ".join(kept)).hexdigest()))
        return pd.DataFrame(out, columns=["text", "n_words", "n_removed", "kept_sha256"])

    run.__annotations__ = {"texts": pd.Series, "found": pd.Series, "return": pd.DataFrame}
    udf = F.pandas_udf(run, "text string, n_words long, n_removed long, kept_sha256 string")
    return joined.withColumn("__cleaned", udf(text, F.col("__dw_runs"))).drop("__dw_runs")


REPEATS_SQL = r"""
WITH w AS (
  SELECT doc_id, COALESCE(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
k AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM w WHERE len(w) >= 20),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM k),
f AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM h),
p AS (SELECT doc_id, unnest(range(i, i + 20)) AS pos FROM f WHERE r > 1),
c AS (SELECT doc_id, list(DISTINCT pos) AS gone FROM p GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, COALESCE(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
              [w[i] for i in range(1, len(w) + 1) if NOT list_contains(gone, i)] END, ' ')) AS kept_sha256
FROM w LEFT JOIN c ON w.doc_id = c.doc_id
"""
