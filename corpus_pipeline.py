"""Corpus preparation as a chain of stages over the documents table.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All stages
but the last return the columns of documents; rows that a stage rejects are
gone for the next one.

1. language: every row's language is predicted; rows whose language can't be
   told (no letter, or no evidence: neither a known word nor a known n-gram of
   two characters or more) go; if no row has a label to learn from, all rows
   with a letter stay.
2. near_dups: of each group of near-duplicates the smallest id stays; of rows
   that share it, one for each different text.
3. repeats: words of repeated windows are taken out of the texts.
4. mixing: every document appears once per time that the mix takes it,
   range-sorted by training position; what the mix doesn't take goes.
5. encoding: token ids of every text and digests of the round trip.

Defined cases: null, empty and letterless texts go in stage 1.  Rows without
an id count as clean: stages 2 and 3 keep them as they are, and stage 4 mixes
them like others.  Rows with one id and different texts are different
documents, except that stage 2 drops an id as a whole.  A source that is null
is a source.  No rows in, no rows out, with the columns as always.  Extra
columns travel along up to the last stage.

SQL can't express the first and last stage, so there is no oracle; the tests
hold every stage against a brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.llm import bpe, language, mixing, near_dup, repeats
from driftwood.llm.common import cut, table
from driftwood.session import ensure_checkpoint_dir


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that language identification rejects."""
    trained = docs.where(~language.held_out(F.col("doc_id")))
    model = language.train(language.training_rows(trained, "doc_id", "text", "lang"))
    return language.with_told_language(docs, model)


def keep_first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    fate = cut(near_dup.near_duplicates(docs).groupBy(F.col("doc_id").alias("__id"))
               .agg(F.max(~F.col("kept")).alias("__gone"), F.count("*").alias("__rows"))
               .where("__gone or __rows > 1"))
    gone = fate.where("__gone").select(F.col("__id").alias("doc_id"))
    stay = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    several = fate.where("__id is not null and not __gone").select(F.col("__id").alias("doc_id"))
    if several.isEmpty():
        return stay
    # rows that share an id: one of those that share the text as well
    return stay.join(several, "doc_id", "left_anti").select(docs.columns).unionByName(
        stay.join(several, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"]))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that have occurred before."""
    cleaned = repeats.remove_repeats(docs)
    text = F.col("__cleaned.text")
    changed = F.col("__cleaned.n_removed") > 0
    return cleaned.withColumn("text", F.when(changed, text).otherwise(F.col("text"))) \
        .withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))) \
        .select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix takes, in training order."""
    mixed = mixing.mix(docs, carry=True)
    return mixing.expand(mixed.where("copies > 0")).select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids per row, with their number and round-trip digests."""
    import public_tokenizers as P
    # half of the caches: the executors hold what the stages before have left too
    encoded = bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, share=0.5)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", keep_known_languages),
    ("near_dups", keep_first_of_near_duplicates),
    ("repeats", cut_repeats),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Language models and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each one's result is written below the
    shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(path := f"{folder}/{i}-{name}")
        docs = spark.read.parquet(path)
    return docs
