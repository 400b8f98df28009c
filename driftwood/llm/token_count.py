"""Token counts by a compiled finite-state transducer.

The merges of a byte-level BPE vocabulary are compiled to a deterministic
transducer over bytes.  A state is what still matters of the bytes read: for
each token that is begun and may go on, its place in the trie of tokens, the
last token before it and how many tokens the encoding up to there has,
relative to the least such number.  A transition carries the number of tokens
that have become certain by it; at the end of a piece the state says how many
more follow.  The encoding itself is never built.  States and transitions are
compiled as texts reach them and shared by all texts of a worker.

Texts are cut into chunks, each chunk is mapped to a summary that holds for
whatever precedes it: (text up to the first place that always begins a piece,
tokens between the first and the last such place, text after the last).
Summaries compose associatively, and a document's are composed pairwise in
log(chunks) rounds, as a parallel prefix scan does.

Spark side: one ``mapInArrow`` pass, no shuffle.  Memory per worker is the
vocabulary and caches of fixed size.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.llm.bpe import RAGGED, Vocabulary, unicode_pattern
from driftwood.llm.common import kept
from driftwood.session import ship_package

#: The pattern of the byte-level pre-tokenizer (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a text that are summarised at a time.
CHUNK = 32_768
#: Entries of each per-worker cache before it is emptied.
UNITS, STATES = 250_000, 300_000


def byte_letters() -> dict[str, int]:
    """letter -> byte of the byte-level alphabet: printable Latin-1 stands
    for itself, every other byte for the next code point from 256 up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Transducer:
    """step[state][byte] -> (state, tokens emitted), compiled on demand."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.forget()

    def forget(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.parts: list[tuple] = []   # state -> begun tokens
        self.ends: list[int] = []      # state -> tokens still due at the end
        self.last: list[int] = []      # state -> last token, -1 at the start
        self.steps: list[dict] = []    # state -> {byte: (state, emitted)}
        self.state((), 0, -1)

    def state(self, begun: tuple, end: int, last: int) -> int:
        key = (end, last, *begun)
        n = self.ids.get(key)
        if n is None:
            n = self.ids[key] = len(self.ends)
            self.parts.append(begun)
            self.ends.append(end)
            self.last.append(last)
            self.steps.append({})
        return n

    def compile(self, s: int, byte: int) -> tuple[int, int]:
        v, begun, last, end = self.v, [], None, 0
        for part, before, n in (*self.parts[s], (b"", self.last[s], self.ends[s])):
            part += bytes((byte,))
            t = v.ranks.get(part)
            if last is None and t is not None and (before < 0 or v.stable(before, t)):
                last, end = t, n + 1
            part = v.prefixes.get(part)
            if part is not None:
                begun.append((part, before, n))
        if last is None:
            raise ValueError(f"byte {byte} is not in the vocabulary")
        sure = min([end, *(n for _, _, n in begun)])
        to = self.state(tuple((p, b, n - sure) for p, b, n in begun), end - sure, last)
        step = self.steps[s][byte] = (to, sure)
        return step

    def count(self, data: bytes) -> int:
        """Tokens of one piece."""
        if len(self.ends) >= STATES:
            self.forget()
        s, total, steps = 0, 0, self.steps
        for byte in data:
            s, sure = steps[s].get(byte) or self.compile(s, byte)
            total += sure
        return total + self.ends[s]


class Counter(dict):
    """unit (what follows a space, up to the next) -> number of tokens;
    bounded, with two generations as in the encoder."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if (model["type"], pre.get("type"), spec["normalizer"]) != ("BPE", "ByteLevel", None) \
                or pre.get("add_prefix_space"):
            raise ValueError("only byte-level BPE without normalisation can be compiled")
        letters = byte_letters()
        own = {a["content"] for a in spec["added_tokens"]}
        bytes_of = lambda t: bytes(letters[c] for c in t)
        merged = [bytes_of("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        single = [bytes_of(t) for t in model["vocab"] if len(t) == 1 and t not in own]
        # ranks in merge order; the bytes themselves come before any merge
        self.fst = Transducer(Vocabulary({t: i for i, t in enumerate([*single, *merged])}))
        self.pieces = unicode_pattern(PATTERN).findall
        special = sorted((a["content"] for a in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        #: White space after anything else begins a piece whatever surrounds it.
        self.sure_start = unicode_pattern(r"\S(?=\s)")
        self.old: dict[str, int] = {}

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings, as a whole."""
        if RAGGED.search(text):
            return sum(self.fst.count(p.encode()) for p in self.pieces(text))
        first, *rest = text.split(" ")
        return (sum(self.fst.count(p.encode()) for p in self.pieces(first))
                + sum(map(self.__getitem__, rest)))

    def __missing__(self, unit: str) -> int:
        n = self.old.get(unit)
        if n is None:
            n = sum(self.fst.count(p.encode()) for p in self.pieces(" " + unit))
        if len(unit) < 100:
            if len(self) >= UNITS:
                self.old = dict(self)
                self.clear()
            self[unit] = n
        return n

    def whole(self, text: str) -> int:
        """Tokens of a text as a whole; a special string is one token and
        separates what is around it."""
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))

    def summary(self, chunk: str) -> tuple:
        """(head, tokens, tail), or (text, None, "") where no place is sure
        to begin a piece.  Special strings hold no white space, so none lies
        across such a place."""
        first = self.sure_start.search(chunk)
        if first is None:
            return chunk, None, ""
        a = b = first.end()
        for found in self.sure_start.finditer(chunk, max(a, len(chunk) - 400)):
            b = found.end()
        return chunk[:a], self.whole(chunk[a:b]), chunk[b:]

    def join(self, left: tuple, right: tuple) -> tuple:
        """The summary of two neighbours; associative."""
        (a, n, b), (c, m, d) = left, right
        if n is None:
            return (a + c, m, d)
        if m is None:
            return (a, n, b + c)
        return (a, n + self.whole(b + c) + m, d)

    def count(self, text: str | None, chunk: int = CHUNK) -> int:
        text = text or ""
        if len(text) <= chunk:
            return self.whole(text)
        maps = [self.summary(text[i:i + chunk]) for i in range(0, len(text), chunk)]
        while len(maps) > 1:
            maps = [self.join(*pair) if len(pair) == 2 else pair[0]
                    for pair in (maps[i:i + 2] for i in range(0, len(maps), 2))]
        head, n, tail = maps[0]
        return self.whole(head) + (0 if n is None else n + self.whole(tail))


def counter(path: str) -> Counter:
    """One counter per worker process and vocabulary, until another operator
    uses the process."""
    counters = kept("token_count")
    if path not in counters:
        counters[path] = Counter(path)
    return counters[path]


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) for every row.  ``path`` is a tokenizers JSON
    file of a byte-level BPE.  A null or empty text has 0 bytes and tokens;
    null ids and repeated rows are kept; other columns are not read."""
    ship_package(df.sparkSession)
    text = F.col(text_col).cast("string")
    src = df.select(F.col(id_col).alias("id"),
                    F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
                    text.alias("text"))
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches):
        c = counter(path)
        for batch in batches:
            found = [c.count(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.int64())],
                names=["id", "n_bytes", "n_tokens"])

    return (src.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long")
            .withColumnRenamed("id", id_col))
