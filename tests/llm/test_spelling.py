"""Spelling variants by trie-node pairs against brute force."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftwood.llm import spelling as S


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, ratio=5):
    out, form = {}, {}
    for w, n in counts.items():
        others = [o for o in counts if near(w, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
        out[w] = [w, form[w], w, n, len(others), counts[form[w]] if form[w] else None]
    for w in counts:
        while form[out[w][2]]:
            out[w][2] = form[out[w][2]]
    return sorted(map(tuple, out.values()))


def vocabulary(seed, n=400, letters="abé", longest=7):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, longest))) for _ in range(n)}
    return {w: rnd.choice([1, 1, 2, 5, 9, 10, 25, 49, 50, 250, 6000]) for w in sorted(words)} | {"c" * 3000: 7, "c" * 3001: 90}


@pytest.mark.parametrize("seed, ratio", [(1, 5), (2, 2), (3, 9)])
def test_variants_same_as_brute_force(spark, seed, ratio):
    counts = vocabulary(seed)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(7)
    got = sorted(tuple(r) for r in S.variants(words, ratio).collect())
    assert got == brute(counts, ratio)


@pytest.mark.parametrize("tasks", [1, 5, 60])
@pytest.mark.parametrize("backward", [False, True])
def test_node_numbers_are_those_of_one_trie(spark, tasks, backward):
    """Equal prefixes have one number and different ones two, whatever the
    borders between tasks; most prefixes here cross several."""
    words = sorted(vocabulary(5, 150, "ab", 6)) + ["aaaaaaaa", "aaaaaaab", ""]
    rows = spark.createDataFrame(list(enumerate(words)), "id long, word string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        got = S.trie_nodes(rows, backward).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    names, parts = {}, {}
    for r in got:
        key = words[r.id][::-1] if backward else words[r.id]
        assert len(r.nodes) == len(key) + 1
        for i, node in enumerate(r.nodes):
            assert names.setdefault(key[:i], node) == node
            assert parts.setdefault(node, key[:i]) == key[:i]
    assert len(got) == len(words)


def test_no_group_of_pairs_outgrows_the_letters(spark):
    counts = vocabulary(4, 900, "abcd", 5)
    words = spark.createDataFrame([(i, w, n) for i, (w, n) in enumerate(counts.items())], "id long, word string, n long")
    rows = S.pairs(words)
    assert rows.count() == sum(2 * len(w) + 1 for w in counts)
    assert rows.groupBy("before", "behind").count().agg(F.max("count")).first()[0] <= 2 * 5


def test_counts_same_as_brute_force(spark):
    rnd = random.Random(6)
    pieces = ["wörtern", "WÖRTERN", "letters", "Letters", "shorty", "two", "÷×÷×÷×÷", "漢letters漢", "x1letters", " ", "\n", "abcdef"]
    rows = [(rnd.choice([i, None, 7]), " ".join(rnd.choices(pieces, k=rnd.randint(0, 60)))) for i in range(150)]
    rows += [(1, None), (2, ""), (3, "letters " * 30_000), (3, "letters " * 30_000)]
    want = Counter()
    for i, t in rows:
        run = ""
        for c in [*(t or ""), " "]:
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                k = h % len(run)
                run = run[:k] + run[k + 1:] if h % 7 == 0 else run
                if len(run) >= 6:
                    want[run] += 1
                run = ""
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    got = S.word_counts(docs.repartition(3), one_in=7, held=3)
    assert {r.word: r.n for r in got.collect()} == {w: n for w, n in want.items() if n >= 5}


def test_nothing_in_nothing_out(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.variants(S.word_counts(empty)).collect() == []
    one = spark.createDataFrame([("lonely", 5)], "word string, n long")
    assert [tuple(r) for r in S.variants(one).collect()] == [("lonely", None, "lonely", 5, 0, None)]
    with pytest.raises(ValueError):
        S.variants(one, ratio=1)
