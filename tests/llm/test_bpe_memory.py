"""What a worker of the byte-level BPE holds doesn't grow with the texts."""

import random

import pyarrow as pa

from driftwood.llm import bpe

RANKS = {bytes((b,)): b for b in range(256)} | {
    t: 256 + i for i, t in enumerate([b"ab", b"ba", b"abab", b"aba", b"bab", b"bb", b"abb", b"abba", b" a", b" ab"])}


def test_no_more_states_than_beginnings_of_tokens():
    rnd, v = random.Random(5), bpe.Vocabulary(RANKS)
    begun = {t[:i] for t in RANKS for i in range(1, len(t) + 1) if set(t) <= set(b"ab cd")}
    for _ in range(3000):
        data = bytes(rnd.choices(b"ab cd", k=rnd.randint(1, 40)))
        assert v.encode(data) == v.merge(data)
    assert len(v.states) <= len(begun)


def test_edits_keep_what_an_edit_leaves_alone():
    rnd, v = random.Random(6), bpe.Vocabulary(RANKS)
    for _ in range(500):
        data, new = (bytes(rnd.choices(b"ab c", k=rnd.randint(0, 40))) for _ in range(2))
        i = rnd.randint(0, len(data))
        j = rnd.randint(i, len(data))
        table, want = bpe.PrefixTable(v, data).replace(i, j, new), data[:i] + new + data[j:]
        whole = bpe.PrefixTable(v, want)
        assert (table.data, table.last) == (want, whole.last) and table.ids() == v.merge(want)
        assert [s.part for s in table.states] == [s.part for s in whole.states]
        assert table.append(new).ids() == v.merge(want + new)


def test_results_are_handed_on_by_slices_of_text(monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 100)
    texts = ["a" * n for n in (99, 1, 1, 250, 0, 30, 80)] + [None, "b" * 100, None, "ä" * 50, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    found = list(bpe.slices(batch))
    assert [r for s in found for r in s.column(0).to_pylist()] == list(range(len(texts)))
    assert [t for s in found for t in s.column(1).to_pylist()] == texts
    size = [sum(len((t or "").encode()) for t in s.column(1).to_pylist()) for s in found]
    assert all(n <= 100 or s.num_rows == 1 for n, s in zip(size, found)) and len(found) < len(texts)
    assert list(bpe.slices(batch.slice(0, 0))) == []


def test_slices_give_the_rows_of_the_whole(spark):
    rnd = random.Random(7)
    rows = [(i, " ".join(rnd.choices(["abba", "bab", "cab,", "é"], k=rnd.randint(0, 30)))) for i in range(200)]
    rows += [(None, None), (3, "")]
    import public_tokenizers as P
    path, df = P.path("byte_bpe_50k.tiktoken"), spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    key = lambda r: (str(r.doc_id), list(r.ids))
    got = sorted(bpe.encode(df, path, P.PATTERN).collect(), key=key)
    enc = bpe.Encoder(bpe.read_ranks(path), P.PATTERN)
    assert [(r.doc_id, list(r.ids), bytes(r.decoded).decode()) for r in got] == sorted(
        ((i, enc.encode(t).tolist(), t or "") for i, t in rows), key=lambda r: (str(r[0]), r[1]))
