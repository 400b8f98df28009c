"""Exact duplicates by Patricia tries against brute force."""

import hashlib
import os
import random

import pytest

from driftwood.llm import trie_owners as T
from pyspark.sql import functions as F


def lowered(text):
    return (text or "").encode().lower()


def brute(rows, best):
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[lowered(t)]
        owner = best((x for x in ids if x is not None), default=None)
        out.append((i, owner, len(ids), owner is None or i == owner, hashlib.sha256(lowered(t)).hexdigest()))
    return sorted(out, key=str)


def table(seed=1, n=600):
    rnd = random.Random(seed)
    texts = ["", None, " ", "a", "A", "É", "é", "ab" * 5000, "AB" * 5000 + "c", "hot " * 20]
    texts += ["".join(rnd.choice("abAB") for _ in range(rnd.randint(0, 7))) for _ in range(60)]
    rows = [(rnd.choice([i, i, i, 7, None]), rnd.choice(texts)) for i in range(n)]
    return rows + [(1000 + i, "Hot " * 20) for i in range(n // 2)] + [(None, "no id"), (None, "no id")]


def test_trie_holds_every_text_and_spills_by_subtree():
    rnd = random.Random(3)
    texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 12))) for _ in range(500)]
    want = {}
    for i, t in enumerate(texts):
        owner, n = want.get(t, (i, 0))
        want[t] = (max(owner, i), n + 1)
    trie = T.Patricia(max)
    for i, t in enumerate(texts):
        trie.insert(t, i)
    assert list(trie.terminals()) == sorted((t, *x) for t, x in want.items())
    # sorted input: what is spilled is final, and what stays is one path
    trie, out = T.Patricia(max), []
    for i, t in sorted(enumerate(texts), key=lambda x: x[1]):
        trie.insert(t, i)
        if trie.size > 1500:
            out += trie.spill(keep=t)
            assert trie.size <= 14 * T.NODE
    out += trie.terminals()
    assert out == sorted((t, *x) for t, x in want.items())
    # any order: parts add up
    tries, parts = T.Tries(max, 2000), []
    for i, t in enumerate(texts):
        tries.insert((len(t), 0, 0), t, i, 1)
        parts += tries.over() if tries.size > 2000 else ()
        assert tries.size <= 2500
    got = {}
    for _, t, owner, n in [*parts, *tries.rest()]:
        o, m = got.get(t, (owner, 0))
        got[t] = (max(o, owner), m + n)
    assert got == want


@pytest.mark.parametrize("options", [{}, {"keep": "smallest"}, {"bits": 1, "budget": 3000},
                                     {"bits": 3, "hot": 3, "salts": 2}, {"hot": 2, "budget": 1}])
def test_same_as_brute_force(spark, options):
    rows = table()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = T.exact_duplicates(docs, **options)
    best = min if options.get("keep") == "smallest" else max
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, best)


def test_other_ids_extra_columns_and_no_rows(spark):
    rows = [("a", "X", 1, "s"), ("b", "x", 2, "s"), (None, "x", 3, "s"), ("c", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, length int, sha string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in T.exact_duplicates(docs).collect()}
    assert got == {("a", "b", 3, False), ("b", "b", 3, True), (None, "b", 3, False), ("c", "c", 1, True)}
    assert T.exact_duplicates(docs.where("false")).collect() == []
    with pytest.raises(ValueError):
        T.exact_duplicates(docs, keep="first")


def test_owners_travel_without_texts_and_hot_rows_by_broadcast(spark):
    docs = spark.createDataFrame(table(), "doc_id long, text string")
    plan = T.exact_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
