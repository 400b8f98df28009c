"""The operators against brute force, the tokenizer libraries, and held-out
rows of the small test tables."""

import hashlib
import os
import random
import re
import sys

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from driftwood.llm import (bpe, fingerprint, hamming, language, licences, mixing, near_dup, queries,
                           repeats, site_tree, token_count)

SF = "/root/testdata/sf0.01"
sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))

PIECES = ["a", "b", " ", "\n", "'s", "'re", "'ll", "12", ".", "!", "$", "é", "漢", "🙂", "　", "\x1c", "\x85",
          "<|endoftext|>", "  ", "the", "tion", "<|endof", "\r\n"]


def strings(n, longest, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("file", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_bpe_equals_the_library(file, docs):
    import tiktoken
    ranks = bpe.read_ranks(P.path(file))
    own = bpe.Encoder(ranks, P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = strings(1500, 40) + [r.text for r in docs.limit(100).collect()] + ["a" * 3000 + " " * 300]
    for t in texts:
        ids = own.encode(t).tolist()
        assert ids == lib.encode_ordinary(t)
        assert own.decode(ids).decode() == t


def test_prefix_tables_append_and_edit_exactly():
    v = bpe.Vocabulary(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")))
    rnd = random.Random(2)
    for t in strings(150, 60, seed=3):
        data = t.encode()
        i = rnd.randint(0, len(data))
        j = min(len(data), i + rnd.randint(0, 6))
        new = "".join(rnd.choice(PIECES) for _ in range(3)).encode()
        assert bpe.PrefixTable(v, data[:i]).append(data[i:]).ids() == v.encode(data)
        assert bpe.PrefixTable(v, data).replace(i, j, new).ids() == v.encode(data[:i] + new + data[j:])


def test_caches_are_emptied_and_results_stay(monkeypatch, docs):
    texts = [r.text for r in docs.limit(60).collect()]
    want = [bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).encode(t).tolist() for t in texts]
    for name in ("UNITS", "PAIRS", "STATES"):
        monkeypatch.setattr(bpe, name, 50)
    monkeypatch.setattr(token_count, "STATES", 50)
    monkeypatch.setattr(token_count, "UNITS", 50)
    small = bpe.Encoder(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    assert [small.encode(t).tolist() for t in texts] == want and len(small) <= 50
    assert [token_count.Counter(P.path("byte_bpe_50k.json")).count(t) for t in texts[:5]] == [len(w) for w in want[:5]]


def test_token_counts_equal_the_library(docs):
    from tokenizers import Tokenizer
    path = P.path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), token_count.Counter(path)
    for t in strings(1500, 40, seed=5) + [r.text for r in docs.limit(100).collect()]:
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert [own.count(t), own.count(t, chunk=5), own.count(t, chunk=64)] == [n] * 3


def test_summaries_compose_associatively():
    own = token_count.Counter(P.path("byte_bpe_50k.json"))
    for t in strings(200, 60, seed=9):
        third = max(1, len(t) // 3)
        a, b, c = own.summary(t[:third]), own.summary(t[third:2 * third]), own.summary(t[2 * third:])
        assert own.join(own.join(a, b), c) == own.join(a, own.join(b, c))


def test_language_on_held_out_rows(spark, docs):
    got = queries.op2_language_id(spark, SF)
    right = got.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null") \
        .agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.95


def test_language_backs_off_to_shorter_grams():
    model = {"langs": ["x", "y"], "words": {"known": np.array([-1.0, -5.0])},
             "grams": {"ab": np.array([-6.0, -2.0]), "c": np.array([-1.0, -3.0])}}
    s = language.Scorer(model, ngram=2)
    assert s["known"].tolist() == [-1.0, -5.0]
    assert s["abc"].tolist() == [-3.5, -2.5]  # "ab", then "c", each one unit
    assert s["zzz"].tolist() == [0.0, 0.0]
    assert s.predict("known")[0] == "x" and s.predict("abc")[0] == "y" and s.predict("1 2") == ("und", 0.0)


def test_language_words_have_their_marks():
    hindi, accent = "\u0939\u093f\u0928\u094d\u0926\u0940", "e\u0301te\u0301"
    s = language.Scorer({"langs": ["x", "y"], "words": {hindi: np.array([-9.0, -1.0]), accent: np.array([-1.0, -9.0])},
                         "grams": {}})
    assert s.predict(f"{hindi}!")[0] == "y" and s.predict(f"1 {accent}")[0] == "x"
    assert [s.predict(x) for x in ("\u00bd", "\u2461", "\u0301 1")] == [("und", 0.0)] * 3


def test_pipeline_keeps_documents_with_evidence(spark):
    import corpus_pipeline
    langs = [f"l{k:02}" for k in range(12)]
    rows = [(i, f"{lang}word".replace("0", "o").replace("1", "i") + " common", lang) for lang in langs
            for i in range(langs.index(lang) * 10, langs.index(lang) * 10 + 10)]
    rows += [(1000, "common", None), (1001, "\u6f22", None), (1002, "12 !", None), (1003, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id for r in corpus_pipeline.keep_known_languages(spark, docs, SF).collect()}
    assert got == set(range(120)) | {1000}
    blind = docs.withColumn("lang", F.lit(None).cast("string"))
    got = {r.doc_id for r in corpus_pipeline.keep_known_languages(spark, blind, SF).collect()}
    assert got == set(range(120)) | {1000, 1001}


def test_licences_find_planted_lines(spark, docs):
    planted = {"apache-2.0": "Licensed under the Apache License", "mit": "Released under the MIT License",
               "gpl": "licensed under the GNU General Public", "cc-by-nc": "Licensed under CC BY-NC"}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in queries.op1_licence_scan(spark, SF).collect():
        want = "+".join(sorted(k for k, v in planted.items() if v in texts[r.doc_id])) or "none"
        assert r.licence == want


def test_licences_leave_talk_and_unknown_licences_alone(spark, docs):
    model = licences.Model(spark, licences.training_rows(docs, "doc_id", "text", 200))
    some = spark.createDataFrame([
        (1, "He lost his driving license.\nNothing here."),
        (2, "Released under the Example Corporation Secret Terms."),
        (3, "intro\nlicensed under the apache license version 2.0\nSPDX-License-Identifier: MIT"),
        (4, "You may redistribute it under the terms of the GNU Lesser General Public License.")], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.per_document(some, model=model).collect()}
    assert got[1].licence == got[2].licence == "none"
    assert got[3].licence == "apache-2.0+mit" and got[3].n_paragraphs == 2
    assert got[4].licence == "lgpl"


PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="<p>x</p>";</script></head><body>
<header>site <a href=/>home</a></header><nav><ul><li><a href=1>one</a><li><a href=2>two</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div><aside>side</aside>
<article><header><h1>Title &amp; more</h1></header><p>First <b>bold
 text<p>Second&nbsp;one<br>line<ul><li>a<li>b</ul><form><input value=x>Sign up</form>
<section id="comments"><article><p>a comment</p></article></section><blockquote>quoted</blockquote></article>
<footer>foot</footer></body></html>"""


def test_main_text_of_a_page():
    assert site_tree.extract(PAGE, set()).split("\n\n") == [
        "Title & more", "First bold text", "Second one line", "a", "b", "quoted"]


def test_style_tree_removes_what_every_page_of_a_host_has(spark):
    rows = [(i, f"http://h.example/{i}", f"<div><p>the same boilerplate</p></div><div><section><p>text {i} of its own"
                f"</p><p>more {i * 7}</p></section></div>") for i in range(30)]
    rows += [(100 + i, f"http://few.example/{i}", "<div><p>the same</p></div>") for i in range(2)]
    got = {r.page_id: r.text for r in site_tree.main_text(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # the shared path "div > p" agrees on every page; the article's doesn't
    assert all(got[i] == f"text {i} of its own\n\nmore {i * 7}" for i in range(30))
    assert got[100] == "the same"  # too few pages to know


def main_texts(spark, htmls, host="h.example"):
    rows = [(i, f"http://{host}/{i}", h) for i, h in enumerate(htmls)]
    got = site_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def test_style_tree_keeps_text_below_many_wrappers(spark):
    for wraps in (["table", "tbody", "tr", "td"] * 3, ["div"] * 30):
        up, down = "".join(f"<{t}>" for t in wraps), "".join(f"</{t}>" for t in reversed(wraps))
        got = main_texts(spark, [f"<div><p>the same</p></div>{up}<p>text {i} of page</p><p>more {i * 7}</p>{down}"
                                 for i in range(12)])
        assert got == [f"text {i} of page\n\nmore {i * 7}" for i in range(12)]


def test_a_constant_sibling_takes_no_other_with_it(spark):
    for few, more in ((12, 0), (9, 5), (1, 3)):  # as many on every page, or not
        own = [[f"part {j} of page {i}" for j in range(few + i % (more + 1))] for i in range(24)]
        for tag in ("p", "div"):
            got = main_texts(spark, ["<div>" + "".join(f"<{tag}>{x}</{tag}>" for x in [*o, "all rights reserved"])
                                     + "</div>" for o in own])
            assert got == ["\n\n".join(o) for o in own]


def test_long_copies_stay_on_their_pages(spark):
    own = [[f"part {j} of page {i if i > 6 else 'x'}" for j in range(9 if i > 6 else 30)] for i in range(60)]
    got = main_texts(spark, ["<div>" + "".join(f"<p>{x}</p>" for x in o) + "</div>" for o in own])
    assert got == ["\n\n".join(o) for o in own]


def test_importance_decides_inside_the_article(spark):
    own = [f"text {i} of its own" if i > 8 else "published nine times" for i in range(30)]
    got = main_texts(spark, [f"<article><h1>title {i}</h1><p>{x}</p><div><p>all you need to know about us</p></div>"
                             "</article>" for i, x in enumerate(own)])
    assert got == [f"title {i}\n\n{x}" for i, x in enumerate(own)]
    # an article that is all there is on its host
    assert main_texts(spark, ["<article><h1>t</h1><p>one text</p></article>"] * 8) == ["t\n\none text"] * 8


def test_a_teaser_in_an_article_hides_no_text(spark):
    text = "a long sentence of the page, number {} {}"
    for left, right in (("<main>", "</main>"), ("<div>", "</div>")):
        got = main_texts(spark, [f"<div><article><p>card {i}</p></article></div>{left}" + "".join(
            f"<p>{text.format(i, j)}</p>" for j in range(5)) + right for i in range(8)])
        assert all(text.format(i, j) in x for i, x in enumerate(got) for j in range(5))


def test_no_node_of_a_large_host_is_left_out(spark):
    wide = "".join(f'<div class="c{k}">the same {k}</div>' for k in range(2200))
    rows = [(i, f"http://h.example/{i}", f"<section>{wide}</section><p>text {i}</p>") for i in range(6)]
    rows += [(100 + i, f"http://h.example/r{i}", f"<div class=rare>all alike</div><p>text r{i}</p>") for i in range(5)]
    rows += rows[:2] + [(200, "http://h.example/n", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted((i, "" if h is None else "text " + u.rpartition("/")[2]) for i, u, h in rows)
    for longest in (1_000_000, 0):
        got = site_tree.main_text(pages, longest=longest).collect()
        assert sorted((r.page_id, r.text) for r in got) == want


def test_names_are_whole_class_or_role_tokens():
    kept = ['section id="side-effects"', 'h2 id="related-work"', 'h2 id="form-of-government"', 'div class="side-effects"',
            'section id="search-algorithms"', 'div id="notice-period"', 'h2 id="search"', 'section id="notices"',
            'h2 class="ui header"', 'div class="side-by-side"']
    gone = ['div class="cookie-notice"', 'div class="x Ad"', 'div class="share_buttons"', 'div class="ad-300x250"',
            'div role="navigation"', 'section id="comments"', 'div id="disqus_thread"', 'ul class="site-footer--dark"']
    for left, right in (("<article>", "</article>"), ("<div>", "</div>")):
        for x in kept + gone:
            page = f"{left}<p>one</p><{x}>two</{x.split()[0]}><p>three</p>{right}"
            assert site_tree.extract(page, set()).split("\n\n") == ["one", *["two"] * (x in kept), "three"], x
    assert site_tree.extract('<div>one</div><div id="sidebar">two</div>', set()) == "one"


def test_main_text_equals_the_articles(spark):
    import html
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op3_main_text(spark, SF).collect():
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def shingles(text, n):
    w = text.split()
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_fingerprints_estimate_containment(spark, docs):
    import hashlib
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in queries.op5_fingerprints(spark, SF).collect()}
    errors = []
    for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1]):
        edited = a[:len(a) - len(a) // 2] + b[:len(a) // 2]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(a)
        x, y = shingles(a, 5), shingles(edited, 5)
        errors.append(got[i].near_edited - len(x & y) / max(1, min(len(x), len(y))))
    assert abs(np.mean(errors)) < 0.04 and np.std(errors) < 0.12


def test_fingerprints_merge(spark):
    words = [f"w{i}" for i in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    df = spark.createDataFrame([(a, b, " ".join(words))], "a string, b string, ab string")
    s = {c: fingerprint.sketch(fingerprint.hashes(F.col(c))) for c in ("a", "b", "ab")}
    r = df.select(*[x.alias(c) for c, x in s.items()]).select(
        (fingerprint.merge(F.col("a"), F.col("b")) == F.col("ab")).alias("same"),
        fingerprint.likeness(F.col("a"), F.col("ab")).alias("inside"),
        fingerprint.likeness(F.col("a"), F.col("b")).alias("half")).first()
    assert r.same and r.inside == 1.0 and abs(r.half - 0.5) < 0.1


def test_mixing_follows_the_schedule(spark):
    rows = [(i, "w " * (5 + i % 13), "abc"[i % 3]) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {}
    for r, (_, _, source) in zip(sorted(got, key=lambda r: r.doc_id), rows):
        by.setdefault(source, []).append(r)
    assert abs(sum(r.taken for r in got) / (1.5 * sum(r["size"] for r in got)) - 1) < 0.01
    for source, slope in zip("abc", mixing.SLOPES):
        rs = by[source]
        target = rs[0].target
        assert abs(sum(r.taken for r in rs) - target) <= 20
        early = sum(r["size"] for r in rs for p in r.positions if p < 0.5) / target
        assert abs(early - (0.5 - slope / 4)) < 0.02  # the integral of 1 + a (2t - 1) up to 1/2
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(7))
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def groups_of(rnd, n):
    """Texts in chains of near copies, with exact copies and short ones."""
    out = []
    while len(out) < n:
        words = [f"v{rnd.randint(0, 5000)}" for _ in range(rnd.randint(0, 80))]
        for _ in range(rnd.randint(1, 6)):
            out.append(" ".join(words))
            words = list(words)
            for _ in range(rnd.randint(0, 3)):
                if words:
                    words[rnd.randrange(len(words))] = f"v{rnd.randint(0, 5000)}"
    return out[:n]


def brute_components(texts, n, num, den):
    sets = [shingles(t.lower(), n) for t in texts]
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("n,threshold,num,den", [(3, "0.85", 85, 100), (5, "0.8", 8, 10)])
def test_near_duplicates_equal_brute_force(spark, n, threshold, num, den):
    texts = groups_of(random.Random(n), 250)
    comp, sizes = brute_components(texts, n, num, den)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in near_dup.near_duplicates(df, shingle=n, threshold=threshold).collect()}
    assert [got[i].component_id for i in range(len(texts))] == comp
    assert [got[i].n_shingles for i in range(len(texts))] == sizes


def test_near_duplicates_of_a_crowd_in_small_blocks(spark, monkeypatch):
    # variants of one text that drift apart: a bucket holds several components
    monkeypatch.setattr(near_dup.confirmed, "__defaults__", (7, 2000))
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(70):
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 10 ** 6)}"
        texts.append(" ".join(w))
    comp, _ = brute_components(texts, 5, 8, 10)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == comp and len(set(comp)) > 1


def brute_repeats(texts, window):
    seen, out = set(), []
    for t in texts:
        w = t.split()
        gone = set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        out.append(" ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize("crowd", [1, 256])
def test_repeats_equal_brute_force(spark, crowd):
    rnd = random.Random(6)
    pool = [[f"p{k}_{i}" for i in range(rnd.randint(18, 70))] for k in range(6)]
    texts = []
    for _ in range(150):
        w = []
        for _ in range(rnd.randint(0, 5)):
            w += rnd.choice(pool) if rnd.random() < 0.4 else [f"v{rnd.randint(0, 40)}" for _ in range(rnd.randint(1, 30))]
        texts.append(" ".join(w))
    texts += ["x " * 100, "x " * 30 + "y", " ".join("ab"[i % 2] for i in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.text for r in repeats.remove_repeats(df, crowd=crowd).select("doc_id", "__cleaned.text").collect()}
    assert [" ".join(got[i].split()) for i in range(len(texts))] == brute_repeats(texts, repeats.WINDOW)


def test_multi_index_returns_the_whole_ball():
    rng = np.random.default_rng(0)
    packed = rng.integers(0, 256, (500, 16), dtype=np.uint8)
    index = hamming.MultiIndex(packed)
    for code in packed[:20]:
        far = np.unpackbits(packed ^ code, axis=1).sum(axis=1)
        for radius in (0, 20, 48, 56, 128):
            assert index.within(code, radius).tolist() == np.flatnonzero(far <= radius).tolist()


def test_hamming_recall_and_scores(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits, got = 0, queries.op9_hamming_search(spark, SF).collect()
    for q in {r.query_id for r in got}:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        score = x @ x[ids.index(q)]
        score[ids.index(q)] = -2
        best = {ids[i] for i in np.lexsort((ids, -score))[:5]}
        hits += len(best & {r.vec_id for r in mine})
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(score[ids.index(r.vec_id)] - r.score) < 1e-12 for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
    assert hits / len(got) >= 0.9


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(spark, name):
    from oracle_check import compare, duck
    assert compare(spark, duck(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF)["status"] == "ok"


def test_pipeline_predicts_the_language_of_every_row(spark, monkeypatch):
    """The first stage keeps the rows that the identification gives a language."""
    import corpus_pipeline
    from driftwood.llm import language
    texts = [(i, "the cat and the dog sat on the mat", "en", "a", 34) for i in range(8)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    only = lambda text: F.struct(F.lit("nowhere").alias("lang_pred"))
    assert corpus_pipeline.keep_known_languages(spark, docs, SF).count() == 8
    monkeypatch.setattr(language, "predictor", lambda spark, model: only)
    assert corpus_pipeline.keep_known_languages(spark, docs, SF).count() == 0


def test_mix_takes_what_the_schedule_places(spark, monkeypatch):
    """op7 counts the copies that have a place in training time."""
    from driftwood.llm import mixing, queries
    docs = [(i, f"a b c {i}", "s") for i in range(6)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string")
    monkeypatch.setattr(queries, "table", lambda *a: docs)
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    assert {r["doc_id"]: r["taken"] for r in queries.op7_source_mixing(spark, SF).collect()} == want and sum(want.values())
    mix = mixing.mix
    monkeypatch.setattr(mixing, "mix", lambda *a: mix(*a).withColumn("positions", F.array(F.lit(2.0))))
    assert {r["taken"] for r in queries.op7_source_mixing(spark, SF).collect()} == {0}


def test_op7_lays_out_whole_documents_in_training_order(spark, monkeypatch):
    """op7 carries the documents, sorts their copies and counts the words in them."""
    from driftwood.llm import mixing, queries
    rows = [(i, "w " * (i % 7), "ab"[i % 2]) for i in range(200)] + [(3, "v v v", "b"), (3, "v v v", "b"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    monkeypatch.setattr(queries, "table", lambda *a: docs)
    got = queries.op7_source_mixing(spark, SF).collect()
    mixed = mixing.mix(docs).collect()
    line = lambda r: (str(r.doc_id), r["size"], r.source_size, r.target, r.taken)
    assert sorted(map(line, got)) == sorted(map(line, mixed))
    # the order in which the run meets the documents
    first = {r.doc_id: min(r.positions, default=2.0) for r in mixed if r.doc_id not in (3, None)}
    met = [first[r.doc_id] for r in got if r.doc_id in first]
    assert met == sorted(met) and len(set(met)) > 50
    # the count is taken in the copies' own texts
    mix = mixing.mix
    other = F.col("doc").withField("text", F.lit("one"))
    monkeypatch.setattr(mixing, "mix", lambda *a: mix(*a).withColumn("doc", other))
    copies = {r.doc_id: r.copies for r in mixed if r.doc_id not in (3, None)}
    assert {r.doc_id: r.taken for r in queries.op7_source_mixing(spark, SF).collect() if r.doc_id in copies} == copies


def test_licence_model_counts_every_paragraph(spark):
    """A word of notices that is common in the corpus, but not among its first
    documents by md5, is no term of the model; counts come from all rows."""
    ids = sorted(range(700), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    rows = [(i, "plain words here" if k < 300 else "plain gnu words here") for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rows = licences.training_rows(docs, "doc_id", "text")
    assert rows.where("prose").count() == 700
    assert "gnu" not in licences.Model(spark, rows).vocabulary
    assert "gnu" in licences.Model(spark, licences.training_rows(docs, "doc_id", "text", 300)).vocabulary
