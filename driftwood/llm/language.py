"""Language identification by words, backing off to character n-grams.

The model holds, per language, log probabilities of the most frequent words
and of the most frequent character n-grams of each length up to ``NGRAM``
(words are padded with a blank on both sides).  A known word scores by its
own log frequency in each language.  An unseen word is covered from the left:
at each character the longest known n-gram that starts there scores, shorter
ones being tried in turn, and a character that even the 1-grams lack scores
nothing.  The predicted language has the largest sum (ties: first by name);
the score is its posterior probability, with word scores tempered because
neighbouring words are not independent.

Training reads a bounded sample of labelled rows: about ``SAMPLE`` per
language, those with the smallest md5 of the id.  Counting runs in Spark; the
model is bounded by ``WORDS`` and ``GRAMS`` entries per language (and gram
length) and ``LANGUAGES`` languages, which is what is broadcast.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
so is every text if there is no labelled row.  Label, source and id are never
inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.llm.common import kept
from driftwood.session import ship_package

#: Labelled rows per language that training reads, about.
SAMPLE = 2_000
#: Model entries kept per language: words, and n-grams of each length.
WORDS, GRAMS, NGRAM = 20_000, 3_000, 4
#: Languages a model can hold; more is an error, none is left out.
LANGUAGES = 1_000
#: Weight of one word's log score in the posterior.
TEMPER = 0.2
#: Entries of a worker's word cache before it is emptied.
CACHE = 200_000

#: A word is a run of letters and combining marks with a letter in it, in
#: training (Java) and prediction (the regex module) alike.
WORD = r"\p{M}*\p{L}[\p{L}\p{M}]*"


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str,
                  sample: int = SAMPLE) -> DataFrame:
    """(lang, text) of the sample: rows whose id's md5, as a share of its
    range, is below ``sample`` / rows of the language.  Counts per language
    are summed map-side; no language is gathered or ranked anywhere."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()
                          & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return labelled.select("lang", "text")
    n = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], r["n"])]), F.col("lang"))
    share = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return labelled.where(share * n < sample).select("lang", "text")


def train(rows: DataFrame, words: int = WORDS, grams: int = GRAMS, ngram: int = NGRAM) -> dict:
    """Fit on (lang, text) rows; returns {"langs", "words", "grams"}."""
    found = rows.select("lang", F.explode(F.regexp_extract_all(
        F.lower("text"), F.lit(WORD), F.lit(0))).alias("item"))
    by_word = found.groupBy("lang", "item").agg(F.count("*").alias("n"))
    padded = F.concat(F.lit(" "), F.col("item"), F.lit(" "))
    starts = lambda k: F.sequence(F.lit(1), F.length(padded) - (k - 1))
    by_gram = None
    for k in range(1, ngram + 1):
        one = (by_word.where(F.length("item") + 2 >= k)
               .select("lang", F.explode(F.transform(starts(k), lambda i: padded.substr(i, F.lit(k)))).alias("item"), "n")
               .groupBy("lang", "item").agg(F.sum("n").alias("n")).withColumn("k", F.lit(k)))
        by_gram = one if by_gram is None else by_gram.unionByName(one)
    counts = by_word.withColumn("k", F.lit(0)).unionByName(by_gram)
    group = Window.partitionBy("lang", "k")
    counts = (counts.withColumn("total", F.sum("n").over(group))
              .withColumn("rank", F.row_number().over(group.orderBy(F.desc("n"), "item")))
              .where(F.col("rank") <= F.when(F.col("k") == 0, words).otherwise(grams)))
    got = counts.select("lang", "k", "item", "n", "total").toPandas()  # bounded by the model's size
    langs = sorted(got["lang"].unique())
    if len(langs) > LANGUAGES:
        raise ValueError(f"{len(langs)} languages; a model holds {LANGUAGES}")
    column = {x: i for i, x in enumerate(langs)}
    model = {"langs": langs, "words": {}, "grams": {}}
    for k, part in got.groupby("k"):
        # an item that a language lacks counts half there; lengths share one scale
        floor = np.zeros(len(langs))
        for lang, total in part.groupby("lang")["total"].first().items():
            floor[column[lang]] = -np.log(2.0 * max(total, 1))
        into = model["words" if k == 0 else "grams"]
        for lang, item, n, total in part[["lang", "item", "n", "total"]].itertuples(index=False):
            row = into.get(item)
            if row is None:
                row = into[item] = floor.copy()
            row[column[lang]] = np.log(n / total)
    return model


class Scorer(dict):
    """word -> log score per language, worked out once for unseen words."""

    def __init__(self, model: dict, ngram: int = NGRAM, temper: float = TEMPER):
        super().__init__()
        self.langs, self.words, self.grams = model["langs"], model["words"], model["grams"]
        self.ngram, self.temper = ngram, temper
        self.nothing = np.zeros(len(self.langs))
        self.find = regex.compile(WORD).findall

    def __missing__(self, word: str) -> np.ndarray:
        row = self.words.get(word)
        if row is None:
            row, n, text, i = self.nothing.copy(), 0, f" {word} ", 0
            while i < len(text):
                for k in range(min(self.ngram, len(text) - i), 0, -1):
                    gram = self.grams.get(text[i:i + k])
                    if gram is not None:
                        row += gram
                        n += 1
                        break
                i += 1
            row = row / max(n, 1)  # one word, one vote, whatever its length
        if len(self) >= CACHE:
            self.clear()
        self[word] = row
        return row

    def predict(self, text: str | None) -> tuple[str, float]:
        words = self.find(text.lower()) if text else ()
        if not words or not self.langs:
            return "und", 0.0
        total = np.zeros(len(self.langs))
        for i in range(0, len(words), 4096):  # blocks bound the memory of a very long text
            total += np.add.reduce(list(map(self.__getitem__, words[i:i + 4096])))
        best = int(total.argmax())
        return self.langs[best], float(1.0 / np.exp((total - total[best]) * self.temper).sum())


def predictor(docs_spark, model: dict):
    """A column function text -> struct<lang_pred, score> of the model."""
    ship_package(docs_spark)
    shared = docs_spark.sparkContext.broadcast(model)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        kept("language")
        scorer = Scorer(shared.value)
        for part in texts:
            yield pd.DataFrame([scorer.predict(t) for t in part], columns=["lang_pred", "score"])

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    found = F.pandas_udf(run, "lang_pred string, score double")
    found.scorer = lambda: Scorer(shared.value)  # the same prediction, for other Python steps
    return found


class Evidence:
    """Whether a text has a known word, or a known n-gram of two characters or
    more in one; without a model, a letter.  Holds only what is known, as sorted
    64-bit hashes: 8 bytes an entry, however many languages know it."""

    def __init__(self, model: dict, ngram: int = NGRAM):
        self.any, self.ngram = not model["langs"], ngram
        self.words = hashes(model["words"])
        self.grams = hashes(g for g in model["grams"] if len(g) > 1)

    def __call__(self, text: str | None) -> bool:
        for found in regex.finditer(WORD, text.lower()) if text else ():
            w = found.group()
            padded = f" {w} "
            if self.any or known([w], self.words) or known(
                    [padded[i:i + k] for k in range(2, self.ngram + 1) for i in range(len(padded) - k + 1)], self.grams):
                return True
        return False


def with_language(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose predicted language is one of the model's; all
    rows if it has none (no labelled row)."""
    if not model["langs"]:
        return docs
    found = predictor(docs.sparkSession, model)(F.col(text_col).cast("string"))
    return docs.where(found["lang_pred"].isin(model["langs"]))


def hashes(items) -> np.ndarray:
    return np.sort(np.fromiter((xxhash.xxh3_64_intdigest(x) for x in items), np.uint64))


def known(items: list[str], of: np.ndarray) -> bool:
    """Whether one of the items is in the sorted hashes."""
    if not len(of):
        return False
    h = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in items), np.uint64, len(items))
    return bool((of[np.minimum(np.searchsorted(of, h), len(of) - 1)] == h).any())


def with_evidence(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has evidence, see ``Evidence``."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Evidence(model))
    place = docs.columns.index(text_col)

    def run(batches):
        kept("language")
        evidence = shared.value
        for batch in batches:  # texts become Python strings one by one
            yield batch.filter(pa.array([evidence(t.as_py()) for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def with_told_language(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of ``with_evidence(with_language(docs, model), model)`` in one
    pass, if the prediction can be made in a Python step: a task has one
    worker, which holds one batch of rows."""
    scorer_of = getattr(predictor(docs.sparkSession, model), "scorer", None)
    if scorer_of is None:
        return with_evidence(with_language(docs, model, text_col), model, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(Evidence(model))
    langs = set(model["langs"])
    place = docs.columns.index(text_col)

    def run(batches):
        kept("language")
        scorer, evidence = scorer_of(), shared.value

        def stays(text: str | None) -> bool:
            return (not langs or scorer.predict(text)[0] in langs) and evidence(text)

        for batch in batches:  # texts become Python strings one by one
            yield batch.filter(pa.array([stays(t.as_py()) for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text mod 4 is 2."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", model: dict | None = None) -> DataFrame:
    """(id, held_out, lang_pred, score) per row; fits on the rows that are
    not held out unless a model is given."""
    if model is None:
        model = train(training_rows(docs.where(~held_out(F.col(id_col))), id_col, text_col, lang_col))
    udf = predictor(docs.sparkSession, model)
    return (docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"),
                        udf(F.col(text_col).cast("string")).alias("p"))
            .select(id_col, "held_out", "p.lang_pred", "p.score"))
