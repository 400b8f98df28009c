"""The registered queries of this subpackage: thin bindings of the operators
to the test tables, with DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from driftwood.llm import bpe, fingerprint, hamming, language, lexical, licences, mixing, near_dup, repeats, site_tree, \
    spelling, token_count, trie_owners
from driftwood.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P
    docs = table(spark, sf_dir, "documents")
    return bpe.digest(bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN))


@query
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source", mixing.WEIGHTS,
                       mixing.SLOPES, (3, 2), 2, True)
    # what a document gives is what its copies with a place in the schedule hold
    return mixing.words_taken(mixed)


ORACLES["op7_source_mixing"] = mixing.MIX_SQL


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P
    counts = token_count.token_counts(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, threshold="0.85")


ORACLES["op8_minhash_near_dedup"] = near_dup.NEAR_SQL


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(table(spark, sf_dir, "documents"))


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "__cleaned.n_words", "__cleaned.n_removed", "__cleaned.kept_sha256")


ORACLES["op10_substring_dedup"] = repeats.REPEATS_SQL


@query
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = site_tree.main_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query
def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.per_document(table(spark, sf_dir, "documents"))


@query
def op9_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op13_trie_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_owners.exact_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op13_trie_owners"] = trie_owners.EXACT_SQL


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), one_in=199))


ORACLES["op12_spelling_variants"] = spelling.VARIANTS_SQL


@query
def op11_pair_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op11_pair_maxscore"] = lexical.SEARCH_SQL
