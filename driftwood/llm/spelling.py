"""Spelling variants by pairs of trie nodes.

Two words are near if one inserted, deleted or replaced code point makes one
of the other.  A word's *form* is its near word with the largest count (ties:
smallest in code point order), if that count is at least ``RATIO`` times its
own; its *root* is where following forms ends.

1. Words are counted in a bounded dictionary per task and summed by Spark.
2. The dictionary is range-sorted, and once more with its words reversed.  In
   that order a trie is a stream: the nodes of a word are those of the word
   before as far as both agree, and new ones beyond.  So each task numbers the
   nodes of its words as they pass, with one path in memory.  A node that the
   words of several tasks share is named after the first task border that it
   crosses and its depth; tasks know the prefixes shared across borders, one
   string a border, no longer than neighbouring words agree.
3. A word yields integer pairs (node of the part before, node of the part
   behind): one per code point that is *skipped* and one per *gap* between
   two.  Words with one skip pair differ by a replacement; a skip pair that is
   another word's gap pair is a deletion there.  Of several equal code points
   in a row only the first skip meets gaps, so a pair of words meets once.
   Words with one pair differ in one code point: there are at most as many as
   letters in use, so no group grows with the corpus.
4. Counts and best candidates are taken per pair in one window, in integers,
   and summed by word.  No pair of words is written out.
5. Counts grow by ``RATIO`` along forms, so a chain is at most the logarithm of
   the largest count long: pointer doubling in as few rounds as that needs.

Defined cases: null texts have no words; a null id reads as the empty text
where an id is asked for; repeated rows count again; no words, no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwood.llm.common import cut
from driftwood.session import ship_package

#: A run of letters, after A-Z are lower-cased.
RUN = "[a-zÀ-ÿ]+"
LETTERS, LEAST, RATIO = 6, 5, 5
#: Words that a task counts before it hands the counts on.
HELD = 200_000
#: Bits of a node's number that count inside a task.
LOCAL = 40


def damaged(word: str, seed: int, one_in: int) -> str:
    """The word without a code point where crc32, continued from ``seed``
    over its UTF-8, is divisible by ``one_in``."""
    h = zlib.crc32(word.encode(), seed)
    if h % one_in:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS,
                least: int = LEAST, one_in: int | None = None, held: int = HELD) -> DataFrame:
    """(word, n) of all texts: words of at least ``letters`` code points that
    occur at least ``least`` times.  ``one_in`` plants misspellings: a word
    of a document loses a code point if crc32("<id>:<word>") is divisible."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        find, counts = re.compile(RUN).findall, Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()),
                                                pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                found = find(text.encode().lower().decode()) if text else ()
                if one_in is None:
                    for w in found:
                        if len(w) >= letters:
                            counts[w] += 1
                else:
                    seed = zlib.crc32(f"{id_ or ''}:".encode())
                    for w, n in Counter(found).items():
                        if len(w) >= letters and len(w := damaged(w, seed, one_in)) >= letters:
                            counts[w] += n
                if len(counts) >= held:
                    yield out()
        yield out()

    return (rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least))


def shared_prefix(a: str, b: str) -> str:
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[:n]


def borders(ordered: DataFrame) -> list[tuple[int, str]]:
    """(task, prefix that its last word shares with the next task's first), in
    order, of the tasks that have words."""
    ends = (ordered.groupBy(F.spark_partition_id().alias("task"))
            .agg(F.min("key").alias("first"), F.max("key").alias("last")))
    after = ends.withColumn("next", F.lead("first").over(Window.orderBy("task")))  # a row per task

    def run(last, following):
        return pd.Series([shared_prefix(a, b or "") for a, b in zip(last, following)])

    run.__annotations__ = {"last": pd.Series, "following": pd.Series, "return": pd.Series}
    shared = F.pandas_udf(run, "string")("last", "next")
    return [(r["task"], r["p"]) for r in after.select("task", shared.alias("p")).orderBy("task").collect()]


class Numbering:
    """Numbers of the trie nodes of one task's words, which come in order.
    ``shared`` are the prefixes at the borders, ``at`` is the task's place."""

    def __init__(self, shared: list[str], at: int):
        self.at, self.count, self.word, self.nodes = at, 0, "", [0]
        self.up = shared[at]
        # the name of each prefix at the lower border: the first border it crosses
        self.low, self.low_nodes = (shared[at - 1] if at else ""), []
        for depth in range(1, len(self.low) + 1):
            first = at - 1
            while first and shared[first - 1][:depth] == self.low[:depth]:
                first -= 1
            self.low_nodes.append(self.crossing(first, depth))

    @staticmethod
    def crossing(border: int, depth: int) -> int:
        return -((border + 1 << LOCAL) + depth)

    def path(self, word: str) -> list[int]:
        """Node numbers of the prefixes of a word, from the empty one on."""
        n = len(shared_prefix(self.word, word))
        nodes = self.nodes[:n + 1]
        low = len(shared_prefix(self.low, word)) if self.low else 0
        up = len(shared_prefix(self.up, word)) if self.up else 0
        for depth in range(n + 1, len(word) + 1):
            if depth <= low:
                nodes.append(self.low_nodes[depth - 1])
            elif depth <= up:
                nodes.append(self.crossing(self.at, depth))
            else:
                self.count += 1
                nodes.append((self.at + 1 << LOCAL) + self.count)
        self.word, self.nodes = word, nodes
        return nodes


def trie_nodes(words: DataFrame, backward: bool = False) -> DataFrame:
    """(id, nodes) of the (id, word) rows: for every prefix (``backward``:
    suffix) by its length the number of its trie node."""
    ship_package(words.sparkSession)
    key = F.reverse("word") if backward else F.col("word")
    ordered = cut(words.select("id", key.alias("key")).orderBy("key"))
    found = borders(ordered)
    place = {task: i for i, (task, _) in enumerate(found)}
    shared = [p for _, p in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = None
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = numbers or Numbering(shared, place[batch.column(2)[0].as_py()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array((numbers.path(k) for k in batch.column(1).to_pylist()), pa.list_(pa.int64()))],
                names=["id", "nodes"])

    return (ordered.withColumn("task", F.spark_partition_id())
            .mapInArrow(run, "id long, nodes array<long>"))


def pairs(words: DataFrame) -> DataFrame:
    """(before, behind, id, n, skip, fresh) of the (id, word, n) rows: a row
    per skipped code point and per gap; ``fresh`` marks skips whose code
    point isn't that before it."""
    def run(word):
        return pd.Series([[i == 0 or w[i - 1] != c for i, c in enumerate(w)] for w in word])

    run.__annotations__ = {"word": pd.Series, "return": pd.Series}
    size = F.size("fresh")
    node = lambda name, i: F.get(F.col(name), i)
    gap = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(
        node("pre", i).alias("before"), node("post", size - i).alias("behind"),
        F.lit(False).alias("skip"), F.lit(False).alias("fresh")))
    skip = F.transform(F.col("fresh"), lambda f, i: F.struct(
        node("pre", i).alias("before"), node("post", size - 1 - i).alias("behind"),
        F.lit(True).alias("skip"), f.alias("fresh")))
    return (words.select("id", "n", F.pandas_udf(run, "array<boolean>")("word").alias("fresh"))
            .join(trie_nodes(words.select("id", "word")).withColumnRenamed("nodes", "pre"), "id")
            .join(trie_nodes(words.select("id", "word"), backward=True).withColumnRenamed("nodes", "post"), "id")
            .select("id", "n", F.explode(F.concat(gap, skip)).alias("p"))
            .select("p.before", "p.behind", "id", "n", "p.skip", "p.fresh"))


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best) of the words that have near ones; best is a struct
    (n, minus id) of the one with the largest count, smallest id first.  It is
    the word itself only if no near word of it in that group counts more."""
    group = Window.partitionBy("before", "behind")
    this = F.struct("n", (-F.col("id")).alias("back"))
    skips = F.count(F.when(F.col("skip"), 1)).over(group)
    gaps = F.count(F.when(~F.col("skip"), 1)).over(group)
    fresh = F.count(F.when(F.col("fresh"), 1)).over(group)
    best_skip = F.max(F.when(F.col("skip"), this)).over(group)
    best_gap = F.max(F.when(~F.col("skip"), this)).over(group)
    best_fresh = F.max(F.when(F.col("fresh"), this)).over(group)
    met = pairs(words).select("id", "n", "skip", "fresh", skips.alias("skips"), gaps.alias("gaps"),
                              fresh.alias("freshes"), best_skip.alias("best_skip"), best_gap.alias("best_gap"),
                              best_fresh.alias("best_fresh"))
    near = F.when(~F.col("skip"), F.col("freshes")).otherwise(
        F.col("skips") - 1 + F.when(F.col("fresh"), F.col("gaps")).otherwise(0))
    best = F.when(~F.col("skip"), F.col("best_fresh")).otherwise(
        F.greatest("best_skip", F.when(F.col("fresh"), F.col("best_gap"))))
    return (met.select("id", near.alias("near"), best.alias("best")).where("near > 0")
            .groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best")))


def roots(links: DataFrame, steps: int) -> DataFrame:
    """(id, root) of the (id, to) links, whose chains have at most ``steps``."""
    now = links.select("id", F.col("to").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(steps, 1))))):
        onward = now.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
        now = cut(now.join(onward, "root", "left")
                  .select("id", F.coalesce("beyond", "root").alias("root")))
    return now


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the (word, n) rows, whose
    words are distinct and not null."""
    if ratio < 2:
        raise ValueError("ratio is 2 or more: counts have to grow along forms")
    # sorted, so a smaller id is a smaller word
    words = cut(cut(counts.select("word", "n").orderBy("word"))
                .select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    near = near_words(words)
    known = cut(words.join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("best.n") >= ratio * F.col("n"), F.col("best")).alias("best")))
    span = known.agg(F.max("n"), F.min("n")).first()
    steps = 0 if span[0] is None else int(math.log(span[0] / max(span[1], 1), ratio) + 1)
    links = known.where("best is not null").select("id", (-F.col("best.back")).alias("to"))
    ends = roots(links, steps)
    name = words.select(F.col("id").alias("__id"), F.col("word").alias("__word"))
    named = (links.join(ends, "id")
             .join(name.withColumnRenamed("__word", "form"), F.col("to") == F.col("__id")).drop("__id")
             .join(name.withColumnRenamed("__word", "root_word"), F.col("root") == F.col("__id"))
             .select("id", "form", "root_word"))
    return (known.join(named, "id", "left")
            .select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near",
                    F.col("best.n").alias("form_n")))


VARIANTS_SQL = r"""
WITH bits AS (SELECT range AS b FROM range(256)),
step AS (SELECT b, list_reduce(list_prepend(b, range(8)),
           lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM bits),
crc AS (SELECT list(v ORDER BY b) AS t FROM step),
runs AS (
  SELECT COALESCE(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
per_doc AS (SELECT id, w, COUNT(*) AS n FROM runs WHERE len(w) >= 6 GROUP BY id, w),
codes AS (
  SELECT w, n, list_prepend(4294967295::BIGINT, flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
           ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END FOR c IN string_split(id || ':' || w, '')])) AS b
  FROM per_doc),
hashed AS (
  SELECT w, n, xor(list_reduce(b, lambda c, x: xor(c // 256, t[(xor(c, x) % 256) + 1])), 4294967295::BIGINT) AS h
  FROM codes, crc),
written AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % len(w))::INT) || substr(w, (h % len(w))::INT + 2) ELSE w END AS word, n
  FROM hashed),
words AS (SELECT word, SUM(n)::BIGINT AS n FROM written WHERE len(word) >= 6 GROUP BY word HAVING SUM(n) >= 5),
cuts AS (
  SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM words),
holes AS (SELECT word, n, left(word, i::INT - 1) || '_' || substr(word, i::INT + 1) AS hole,
                 left(word, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM cuts),
near AS (
  SELECT a.word, b.word AS other, b.n FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON h.rest = w.word
  UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON h.rest = w.word),
best AS (
  SELECT word, COUNT(*) AS n_near, MAX(n) AS top FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, COALESCE(n_near, 0)::BIGINT AS n_near,
         (SELECT MIN(other) FROM near WHERE near.word = w.word AND near.n = b.top AND b.top >= 5 * w.n) AS form
  FROM words w LEFT JOIN best b ON w.word = b.word),
walk AS (
  WITH RECURSIVE r AS (
    SELECT word, word AS reached, 0 AS k FROM forms
    UNION ALL SELECT r.word, f.form, k + 1 FROM r JOIN forms f ON r.reached = f.word WHERE f.form IS NOT NULL)
  SELECT word, arg_max(reached, k) AS root FROM r GROUP BY word)
SELECT f.word, f.form, walk.root, f.n, f.n_near, g.n AS form_n
FROM forms f JOIN walk ON f.word = walk.word LEFT JOIN words g ON f.form = g.word
"""
