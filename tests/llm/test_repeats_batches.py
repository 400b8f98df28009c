"""Deciding equal spans inside a batch, and repeats that are spread over
batches, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from driftwood.llm import repeats as R


def test_document_ranks_follow_id_and_hash():
    rnd = random.Random(1)
    for kind in (int, str):
        rows = [(kind(rnd.randint(0, 9)), rnd.randint(-3, 3)) for _ in range(80)]
        rank = R.document_ranks(pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()))
        places = {r: i for i, r in enumerate(sorted(set(rows)))}
        assert rank.tolist() == [places[r] for r in rows]


def test_first_of_equal_spans():
    rnd = np.random.default_rng(2)
    for _ in range(50):
        n = int(rnd.integers(1, 60))
        anchor, span, doc, first = (rnd.integers(0, k, n).astype(np.uint64 if k < 4 else np.int64) for k in (2, 3, 5, 4))
        one, sure = R.first_of_equal(anchor, span, doc, first)
        for key in {(a, s) for a, s in zip(anchor, span)}:
            mine = [i for i in range(n) if (anchor[i], span[i]) == key]
            least = min((doc[i], first[i]) for i in mine)
            assert sum(one[i] for i in mine) == 1 and all((doc[i], first[i]) == least for i in mine if one[i])
            assert all(sure[i] == ((doc[i], first[i]) != least) for i in mine)


@pytest.mark.parametrize("parts", [1, 4])
def test_same_as_brute_force_over_batches(spark, parts):
    rnd = random.Random(3)
    passages = [[f"p{k}w{i}" for i in range(30)] for k in range(3)]
    rows = []
    for d in range(60):
        words = [rnd.choice(["a", "b", "c", "d"]) + str(rnd.randint(0, 30)) for _ in range(rnd.randint(0, 50))]
        for _ in range(rnd.randint(0, 3)):
            p, cut = rnd.choice(passages), rnd.randint(0, 8)
            at = rnd.randint(0, len(words))
            words[at:at] = p[cut:]
        rows.append((rnd.choice([d, d, d, 5]), " ".join(words)))
    rows += rows[:4] + [(99, rows[10][1])]
    # brute force: documents in the order of (id, hash of the text), equal rows once
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = [(r[0], r[1], r[2]) for r in docs.selectExpr("doc_id", "hash(text) h", "text").distinct().orderBy("doc_id", "h").collect()]
    seen, want = set(), {}
    for i, h, text in order:
        words, gone = text.split(), set()
        for k in range(len(words) - 19):
            w = tuple(words[k:k + 20])
            if w in seen:
                gone.update(range(k, k + 20))
            seen.add(w)
        want[i, text] = len(gone)
    got = R.remove_repeats(docs.repartition(parts)).select("doc_id", "text", "__cleaned.n_removed").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_removed"] == want[r["doc_id"], r["text"]], r["doc_id"]
