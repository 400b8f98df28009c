"""Pair-bound MaxScore against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from driftwood.llm import lexical as L

WORDS = [f"w{i}" for i in range(40)] + ["É", "é", "漢字", "Mixed", "mixed", "x1"]


def split(text):
    out, run = [], ""
    for c in [*(text or ""), " "]:
        if ord(c) > 127 or c.isalnum():
            run += c.lower() if c.isascii() else c
        elif run:
            out.append(run)
            run = ""
    return out


def brute(docs, queries, k):
    terms = [(i, Counter(split(t)), len(split(t))) for i, t in docs if split(t)]
    big_n, length = len(terms), sum(n for _, _, n in terms)
    df = Counter(t for _, c, _ in terms for t in c)
    out = []
    for qid, text in dict.fromkeys((q, t) for q, t in queries if t is not None):
        want = Counter(split(text))
        scores = []
        for i, c, n in terms:
            m = 75 + 25 * n * big_n // length
            score = sum(times * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1)))
                        * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in want.items() if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(qid, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def corpus(seed, n=500):
    rnd = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    docs = [(rnd.choice([i, i, i, 5, None]), rnd.choice([" ", "-", "\n"]).join(
        rnd.choices(WORDS, weights, k=rnd.randint(0, 25)))) for i in range(n)]
    docs += [(900, None), (901, ""), (902, " .!? "), (903, "w1 " * 30_000), (904, "w9 w39"), (905, "w9 w39")]
    queries = [(q, " ".join(rnd.choices(WORDS, k=rnd.randint(1, 14)))) for q in range(25)]
    queries += [(1, queries[1][1]), (50, None), (51, ""), (52, "nowhere to be found"), (53, "w9 w39 w39 w39"), (None, "w3 É")]
    return docs, queries


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"block": 16}), (3, {"block": 7, "postings": 20, "k": 3}),
                                           (4, {"block": 16, "pack": 40, "k": 5})])
def test_same_as_brute_force(spark, seed, options):
    docs, queries = corpus(seed)
    d = spark.createDataFrame([(*r, 0, "x") for r in docs], "doc_id long, text string, n int, terms string").repartition(3)
    q = spark.createDataFrame([(*r, 0) for r in queries], "item_id long, text string, rank int")
    got = L.search(d, q, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, queries, options.get("k", 20))


def test_text_ids_and_empty_tables(spark):
    d = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "z")], "doc_id string, text string")
    q = spark.createDataFrame([("q", "X")], "item_id string, text string")
    assert [(r.rank, r.doc_id) for r in L.search(d, q).orderBy("rank").collect()] == [(1, "a"), (2, "b"), (3, None)]
    assert L.search(d.where("false"), q).collect() == [] == L.search(d, q.where("false")).collect()
    assert L.search(d, q.where("false")).columns == ["item_id", "rank", "doc_id", "score"]


def made(rnd, n_docs=300, n_terms=12):
    docs, terms = map(np.array, zip(*[(d, t) for d in range(n_docs) for t in range(n_terms) if rnd.random() < .15]))
    return L.Block(n_docs, docs, terms, np.array([rnd.randint(1, 1000) for _ in docs]), n_terms), docs, terms


def test_pair_bounds_hold_and_are_tighter_than_term_maxima():
    rnd = random.Random(7)
    pairs_scored = terms_scored = 0
    for _ in range(30):
        block, _, _ = made(rnd)
        query = {t: rnd.randint(1, 3) for t in rnd.sample(range(12), 7)}
        units = L.pair_up([query], np.array(range(12)))
        block.intersect(units.pairs)
        bound = block.bounds(units)
        single = L.Units(np.array([0, 7]), np.array(list(query)), np.full(7, -1), np.array(list(query.values())),
                         np.zeros(7, np.int64), np.full(7, -1))
        loose = block.bounds(single)
        score = np.zeros(block.n_docs, np.int64)
        for t, times in query.items():
            docs, impact = block.postings(t)
            score[docs] += times * impact
        assert score.max() <= bound.sum() <= loose.sum()
        best = np.lexsort((np.arange(block.n_docs), -score))[:10]
        for least in (0, int(score[best[9]]), int(score[best[2]])):
            a, b = L.Counter(), L.Counter()
            at, got = block.search(units, bound, 0, least, 10, a)
            keep = [d for d in best if score[d] >= max(least, 1)]
            assert at.tolist() == keep and got.tolist() == score[keep].tolist()
            assert block.search(single, loose, 0, least, 10, b)[0].tolist() == keep
            pairs_scored, terms_scored = pairs_scored + a["scored"], terms_scored + b["scored"]
    assert pairs_scored < terms_scored


def test_joint_maximum_is_that_of_documents_with_both():
    block, docs, terms = made(random.Random(8))
    block.intersect([(0, 1), (2, 3)])
    impact = {(d, t): i for t in range(12) for d, i in zip(*block.postings(t))}
    for n, (a, b) in enumerate([(0, 1), (2, 3)]):
        both = {d for d, t in zip(docs, terms) if t == a} & {d for d, t in zip(docs, terms) if t == b}
        assert set(block.both[n]) == both
        assert block.joint[n] == max(impact[d, a] + impact[d, b] for d in both)


def test_blocks_keep_every_row_and_their_bounds():
    import pyarrow as pa
    rnd = random.Random(9)
    sizes = [rnd.choice([0, 1, 3, 50]) for _ in range(200)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([1] * 200), pa.array([[1] * s for s in sizes]),
                                       pa.array([[1] * s for s in sizes])], names=["id", "n", "terms", "tfs"])
    parts = list(L.blocks_of(iter([rows.slice(0, 0), rows.slice(0, 33), rows.slice(33)]), 10, 60))
    assert [i for p in parts for i in p.column("id").to_pylist()] == list(range(200))
    for p in parts:
        n = [len(x) for x in p.column("terms").to_pylist()]
        assert len(n) <= 10 and sum(n[:-1]) < 60
