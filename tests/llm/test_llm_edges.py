"""Every operator and pipeline stage on awkward tables: nulls in any column,
empty and very long texts, ties and repeated rows, no rows at all, and extra
columns named like the operators' own."""

import hashlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from driftwood.llm import (bpe, fingerprint, hamming, language, licences, mixing, near_dup,
                           repeats, site_tree, token_count)

LONG = " ".join(f"word{i % 977} the {i}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
REST = " ".join("{}%d" % i for i in range(40))
CLASH = ["id", "words", "key", "keys", "rank", "bucket", "size", "position", "doc", "start", "path",
         "copies", "text_b", "label", "features", "p", "runs", "__id", "host", "head", "comp", "span"]
FIELDS = [("doc_id", "long"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "long")]
SCHEMA = T.StructType([T.StructField(n, {"long": T.LongType(), "string": T.StringType()}[t]) for n, t in FIELDS]
                      + [T.StructField(c, T.StringType()) for c in CLASH])
TEXTS = [
    (1, "The cat sat on the mat and the dog lay by the door of the house all day long.", "en", "a"),
    (2, "Le chat est sur le tapis et le chien est devant la porte de la maison toute la journée.", "fr", "b"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, " \t\n ", None, "b"),
    (6, "12 34 !!", "en", None),
    (7, LONG, "en", "a"),
    (8, LONG, "en", "a"),
    (9, "one two", "en", "c"),
    (9, "one two", "en", "c"),
    (None, "a row without an id", "en", "c"),
    (10, f"before {REST.format(*'a' * 40)} {PASSAGE} after it", "en", "a"),
    (11, f"elsewhere {REST.format(*'b' * 40)} {PASSAGE} and more", "en", "a"),
    (12, "é漢🙂 x  y \n\n z<|endoftext|>", "fr", "b"),
]


def rows():
    return [(i, t, lang, src, None if t is None else len(t), *(["x"] * len(CLASH))) for i, t, lang, src in TEXTS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, out.values())) == len(TEXTS)
    return out


def test_licences(docs, none):
    got = by_id(licences.per_document(docs))
    assert {r.licence for rs in got.values() for r in rs} == {"none"}
    assert got[3][0].n_paragraphs == got[4][0].n_paragraphs == 0
    assert licences.per_document(none).count() == 0


def test_language(docs, none):
    got = by_id(language.identify(docs))
    for i in (3, 4, 5, 6):
        assert (got[i][0].lang_pred, got[i][0].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for rs in got.values() for r in rs)
    assert got[7][0].lang_pred == got[8][0].lang_pred == "en"
    assert language.identify(none).count() == 0
    # no labelled row at all: nothing can be told
    blind = language.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in blind.collect()} == {"und"}


def test_main_text(spark):
    schema = "page_id long, url string, html string, host string, low string, path string, text string"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    pages = spark.createDataFrame([
        (1, None, None, "x", "x", "x", "x"), (2, "nonsense", "", "x", "x", "x", "x"),
        (3, "http://a.example/1", "<p>only <b>text", None, None, None, None),
        (3, "http://a.example/1", "<p>only <b>text", None, None, None, None),
        (None, "http://a.example/2", "no markup &amp; <", "x", "x", "x", "x"),
        (5, "http://a.example/3", deep, "x", "x", "x", "x"),
        (6, "http://a.example/4", f"<article><p>{LONG}</p></article><footer>f</footer>", "x", "x", "x", "x"),
    ], schema)
    got = [(r.page_id, r.text) for r in site_tree.main_text(pages).collect()]
    assert sorted(got, key=str) == sorted([(1, ""), (2, ""), (3, "only text"), (3, "only text"),
                                           (None, "no markup & <"), (5, "deep"), (6, LONG)], key=str)
    assert site_tree.main_text(pages.limit(0)).count() == 0


def test_bpe(docs, none):
    path = P.path("byte_bpe_50k.tiktoken")
    got = by_id(bpe.encode(docs, path, P.PATTERN))
    assert got[3][0].ids == got[4][0].ids == [] and got[3][0].decoded == b""
    texts = dict((i, t) for i, t, *_ in TEXTS)
    for i, rs in got.items():
        assert bytes(rs[0].decoded).decode() == (texts[i] or "")
    again = bpe.decode(bpe.encode(docs, path, P.PATTERN, decoded=False), path, P.PATTERN)
    assert {(r.doc_id, bytes(r.decoded)) for r in again.collect()} \
        == {(i, bytes(r.decoded)) for i, rs in got.items() for r in rs}
    assert bpe.encode(none, path, P.PATTERN).count() == 0


def test_fingerprints(docs, none):
    got = by_id(fingerprint.edited_pairs(docs))
    assert got[3][0].fingerprint == "" and got[3][0].n_chars == 0
    assert got[7][0].fingerprint == got[8][0].fingerprint != ""
    assert got[8][0].near_next == 1.0  # 7 follows 8 and is its equal
    assert got[9][0].fingerprint == got[9][1].fingerprint
    # descending ids, the row without an id last, then from the start again
    assert got[None][0].edited_sha256 == hashlib.sha256(
        ("a row without an id"[:10] + TEXTS[-1][1][:9]).encode()).hexdigest()
    assert fingerprint.edited_pairs(none).count() == 0


def test_token_counts(docs, none):
    got = by_id(token_count.token_counts(docs, P.path("byte_bpe_50k.json")))
    assert (got[3][0].n_bytes, got[3][0].n_tokens) == (got[4][0].n_bytes, got[4][0].n_tokens) == (0, 0)
    assert got[7][0].n_tokens == got[8][0].n_tokens > 60_000
    assert token_count.token_counts(none, P.path("byte_bpe_50k.json")).count() == 0


def test_mixing(docs, none):
    got = by_id(mixing.mix(docs))
    assert (got[3][0].size, got[3][0].taken, got[4][0].taken) == (0, 0, 0)
    assert got[3][0].source_size == 3  # null sources are one source
    assert all(r.taken <= 2 * r["size"] and len(r.positions) == r.copies for rs in got.values() for r in rs)
    assert mixing.mix(none).count() == 0
    carried = mixing.expand(mixing.mix(docs, carry=True))
    assert carried.select("doc.*").columns == docs.columns


def test_near_duplicates(docs, none):
    got = by_id(near_dup.near_duplicates(docs))
    assert [r.n_shingles for r in got[3] + got[4] + got[5]] == [0, 0, 0]
    assert (got[8][0].component_id, got[8][0].kept, got[7][0].kept) == (7, False, True)
    assert [r.component_id for r in got[9]] == [9, 9]
    assert got[None][0].component_id is None and got[None][0].kept
    assert all(r.kept and r.component_id == i for i in (3, 4, 5, 6) for r in got[i])
    assert near_dup.near_duplicates(none).count() == 0


def test_hamming(spark):
    schema = "vec_id long, embedding array<float>, id string, v string, block string, score string"
    x = ["x"] * 4
    df = spark.createDataFrame([
        (0, [1.0, 0.0, 0.0], *x), (1, [2.0, 0.0, 0.0], *x), (2, [1.0, 0.0, 0.0], *x), (3, [0.0, 1.0, 0.0], *x),
        (4, None, *x), (5, [0.0, 0.0, 0.0], *x), (6, [1.0, None, 0.0], *x), (7, [1.0, float("nan"), 0.0], *x),
        (8, [], *x), (9, [float("inf"), 0.0, 0.0], *x), (None, [1.0, 0.0, 0.0], *x), (3, [0.0, 1.0, 0.0], *x),
        (10, [1.0, 1.0], *x)], schema)
    got = [tuple(r) for r in hamming.nearest(df, F.col("vec_id") == 0, k=5).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0)]
    empty = hamming.nearest(df.limit(0), F.col("vec_id") == 0)
    assert empty.columns == ["query_id", "rank", "vec_id", "score"] and empty.count() == 0


def test_repeats(docs, none):
    cleaned = repeats.remove_repeats(docs)
    assert set(docs.columns) < set(cleaned.columns)
    got = by_id(cleaned.select("doc_id", "__cleaned.*"))
    assert (got[3][0].n_words, got[3][0].text, got[4][0].n_words) == (0, None, 0)
    assert got[8][0].n_removed == got[8][0].n_words and got[8][0].text == ""
    assert (got[10][0].n_removed, got[11][0].n_removed, got[11][0].text) \
        == (0, 60, f"elsewhere {REST.format(*'b' * 40)} and more")
    assert got[9][0].n_removed == 0 and got[12][0].text == TEXTS[-1][1]
    assert repeats.remove_repeats(none).count() == 0


def test_stages(spark, docs, none, tmp_path):
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, "unused")
        stage(spark, none, "unused").write.parquet(str(tmp_path / f"none-{name}"))
        assert spark.read.parquet(str(tmp_path / f"none-{name}")).count() == 0
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        if name != "encoding":
            assert at.columns == docs.columns
        if name == "language":
            left = {r.doc_id for r in at.collect()}
            assert not left & {3, 4, 5, 6} and {1, 2, 7, 8} <= left
        if name == "near_dups":
            left = {r.doc_id for r in at.collect()}
            assert 7 in left and 8 not in left and {1, 2, 10, 11, None} <= left
        if name == "repeats":
            assert all(PASSAGE not in r.text for r in at.collect() if r.doc_id == 11)
    assert at.columns[0] == "doc_id" and at.where("n_tokens = 0").count() == 0


def test_pipeline_keeps_one_of_repeated_rows(spark):
    schema = T.StructType([T.StructField(n, {"long": T.LongType(), "string": T.StringType()}[t]) for n, t in FIELDS])
    data = [(1, "one and the same row", "en", "a", 20)] * 3 + [(1, "another text of that id", "en", "a", 23),
                                                               (2, "one and the same row", "en", "a", 20),
                                                               (3, "on its own in here", "en", "b", 18)] + [(None, "x", "en", "b", 1)] * 2
    got = corpus_pipeline.keep_first_of_near_duplicates(spark, spark.createDataFrame(data, schema).repartition(3), "")
    assert got.columns == [n for n, _ in FIELDS]
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=str) == sorted(
        [(1, "one and the same row"), (1, "another text of that id"), (3, "on its own in here"), (None, "x"), (None, "x")], key=str)


def test_a_worker_keeps_the_caches_of_one_operator():
    from driftwood.llm import common
    common.kept("a")["x"] = 1
    assert common.kept("a") == {"x": 1}
    common.kept("b")["y"] = 2
    assert common.kept("b") == {"y": 2} and common.kept("a") == {}
    assert common.kept("b") == {}


def test_evidence_same_as_looking_items_up():
    model = {"langs": ["a", "b"], "words": {"hund": None, "chat": None}, "grams": {"q": None, "st": None, " zz": None}}
    evidence = language.Evidence(model)
    for text, want in [("Hund", True), ("xx chat", True), ("q", False), ("last", True), ("zzz", True), ("azz", False),
                       ("12", False), ("", False), (None, False)]:
        assert evidence(text) is want, text
    nothing = language.Evidence({"langs": [], "words": {}, "grams": {}})
    assert nothing("a") and not nothing("1")


def test_labels_in_running_text_stay(spark):
    html = "<article><p>Press <label>Start</label> now and wait for the light.</p><form><label>Name</label></form></article>"
    got = site_tree.main_text(spark.createDataFrame([(1, "http://a/b", html)], "page_id long, url string, html string"))
    assert got.first()["text"] == "Press Start now and wait for the light."
