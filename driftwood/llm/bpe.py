"""Byte-level BPE by dynamic programming over prefixes.

For every byte prefix of a piece exactly one token can be the last token of
that prefix's BPE encoding.  ``PrefixTable`` stores it per prefix: appending
bytes only adds entries, the encoding is read backwards from the end, and an
edit recomputes entries from the edit until the table meets the old one.

A token ``t`` ending at prefix ``i`` is the valid last token iff the pair
(last token of the prefix before ``t``, ``t``) is *stable*: BPE on the two
tokens' bytes gives back the two tokens.  Which tokens end at a prefix depends
only on its longest ending that is the beginning of a token; such an ending is
a ``State``.  Each step from one state to the next is worked out once and then
kept, and so is which pairs are stable; there are no more states than
beginnings of tokens, whatever the texts are.

Spark side: ``encode`` is one ``mapInArrow`` pass over the texts without a
shuffle; a lost executor only repeats its input splits.  Memory per worker is
the vocabulary plus caches of fixed size, and the results of ``SLICE``
bytes of text (of one text, if it is longer).
"""

from __future__ import annotations

import base64
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.llm.common import kept
from driftwood.session import ship_package

#: Entries of each per-worker cache before it is emptied.
UNITS, PAIRS, STATES = 250_000, 500_000, 300_000
#: Bytes of text whose results a worker gathers before it hands them on.
SLICE = 1_000_000


def unicode_pattern(pattern: str):
    """The piece pattern compiled with white space in Unicode's sense, as
    the tokenizer libraries read it."""
    import regex
    return regex.compile(pattern.replace(r"\S", r"\P{White_Space}")
                         .replace(r"\s", r"\p{White_Space}"))


#: A space after white space: where a text can't be cut at single spaces.
RAGGED = re.compile(r"\s ")


def units(text: str) -> list[str] | None:
    """The text cut before each space, the space left out (but for the first
    unit); None if a space follows white space.  White space after anything
    else always begins a piece, so units can be split into pieces apart."""
    return None if RAGGED.search(text) else text.split(" ")


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank from a rank file (base64 token, rank per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class Vocabulary:
    """Tokens by rank; rank order is merge order."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.prefixes = {p: p for t in ranks for p in (t[:i] for i in range(1, len(t)))}
        self._spines: dict[int, tuple] = {}
        self._known: dict[int, Before] = {}  # by second token
        self.pairs = 0
        self.forget()

    def forget(self) -> None:
        """Start the kept steps anew."""
        self.states: dict[bytes, State] = {}
        self.root = State(self, b"")

    def merge(self, data: bytes, below: int | None = None) -> list[int]:
        """BPE by repeated lowest-rank merging, using ranks under ``below``;
        quadratic, used on single tokens only."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def spines(self, t: int) -> tuple:
        """((token's bytes, rank that absorbs it), ...) down the right edge
        and down the left edge of token ``t``'s merge tree."""
        s = self._spines.get(t)
        if s is None:
            right, left = [(self.tokens[t], 1 << 40)], [(self.tokens[t], 1 << 40)]
            if len(self.tokens[t]) > 1:
                a, b = self.merge(self.tokens[t], below=t)
                right += [(x, min(r, t)) for x, r in self.spines(b)[0]]
                left += [(x, min(r, t)) for x, r in self.spines(a)[1]]
            s = self._spines[t] = (tuple(right), tuple(left))
        return s

    def before(self, t: int) -> Before:
        """Which tokens are stable before ``t``, as far as is known."""
        known = self._known.get(t)
        if known is None:
            known = self._known[t] = Before(self, t)
        return known

    def stable(self, a: int, b: int) -> bool:
        """True if BPE leaves tokens ``a b`` side by side."""
        return self.before(b)[a]

    def extend(self, s: State, last: list[int], data: bytes) -> State:
        """Append to ``last``, the last token of every prefix (-1 of the empty
        one), those of the prefixes that end in ``data``; ``s`` is the state
        before it, the state after it is returned."""
        for byte in data:
            s = s[byte]
            for n, t, stable in s.ends:
                if stable[last[-n]]:
                    last.append(t)
                    break
            else:
                raise ValueError(f"byte {byte} is not in the vocabulary")
        return s

    def encode(self, data: bytes) -> list[int]:
        """The BPE encoding of one piece."""
        if len(self.states) >= STATES:
            self.forget()
        self.extend(self.root, last := [-1], data)
        return backwards(last, self.tokens)


def backwards(last: list[int], tokens: dict) -> list[int]:
    """The encoding of the whole, given every prefix's last token."""
    out, i = [], len(last) - 1
    while i:
        t = last[i]
        out.append(t)
        i -= len(tokens[t])
    return out[::-1]


class Before(dict):
    """token -> whether it is stable before token ``t`` (-1, the beginning of
    the piece, is), worked out when asked for.  Two edge parts merge if their
    merge comes before either is absorbed; at equal rank the leftmost merge
    comes first."""

    __slots__ = ("v", "t")

    def __init__(self, v: Vocabulary, t: int):
        self.v, self.t = v, t

    def __missing__(self, a: int) -> bool:
        v, ok = self.v, True
        if v.pairs >= PAIRS:
            v.pairs = 0
            for known in v._known.values():
                known.clear()
        if a >= 0:
            get, left = v.ranks.get, v.spines(self.t)[1]
            for x, x_until in v.spines(a)[0]:
                for y, y_until in left:
                    m = get(x + y)
                    if m is not None and m < x_until and m <= y_until:
                        ok = False
        v.pairs += 1
        self[a] = ok
        return ok


class State(dict):
    """byte -> next State, filled as steps are taken.  ``part`` is the longest
    ending of the bytes so far that is a token or the beginning of one;
    ``ends`` holds (length, token, what is stable before it) of every token
    that ends here, longest first."""

    __slots__ = ("v", "part", "ends")

    def __init__(self, v: Vocabulary, part: bytes):
        self.v, self.part = v, part
        self.ends = tuple((n, t, v.before(t)) for n in range(len(part), 0, -1)
                          if (t := v.ranks.get(part[-n:])) is not None)

    def __missing__(self, byte: int) -> State:
        v, part = self.v, self.part + bytes((byte,))
        while part and part not in v.prefixes and part not in v.ranks:
            part = part[1:]
        s = v.states.get(part) if part else v.root
        if s is None:
            s = v.states[part] = State(v, part)
        self[byte] = s
        return s


class PrefixTable:
    """The state and the last token at every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v = vocabulary
        self.data = b""
        self.states, self.last = [vocabulary.root], [-1]
        self.append(data)

    def append(self, more: bytes) -> PrefixTable:
        for i in range(len(more)):
            self.states.append(self.v.extend(self.states[-1], self.last, more[i:i + 1]))
        self.data += more
        return self

    def replace(self, start: int, stop: int, new: bytes) -> PrefixTable:
        """Replace ``data[start:stop]``: entries are taken anew from there
        until what decides on all further ones (the state, and the last tokens
        as far back as its part reaches) is as it was; the rest is kept."""
        tail, states, last = self.data[stop:], self.states, self.last
        self.data = self.data[:start]
        self.states, self.last = states[:start + 1], last[:start + 1]
        self.append(new)
        for i in range(len(tail)):
            part, at = self.states[-1].part, stop + i
            if part == states[at].part and self.last[-len(part) - 1:] == last[at - len(part):at + 1]:
                self.states += states[at + 1:]
                self.last += last[at + 1:]
                break
            self.append(tail[i:i + 1])
        self.data = self.data[:start + len(new)] + tail
        return self

    def ids(self) -> list[int]:
        return backwards(self.last, self.v.tokens)


class Encoder(dict):
    """Texts to ids and back.  Maps a unit (what follows a space, up to the
    next) to the ids of its pieces, the space included, as bytes of int32;
    bounded, with two generations: when the young one is full it becomes the
    old one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, share: float = 1.0):
        super().__init__()
        self.v, self.share = Vocabulary(ranks), share
        self.pieces = unicode_pattern(pattern).findall
        self.old: dict[str, bytes] = {}

    def packed(self, text: str) -> bytes:
        """The ids of a text's pieces; a piece that is a token is that token."""
        whole, ids = self.v.ranks.get, array("i")
        for piece in self.pieces(text):
            t = whole(data := piece.encode())
            if t is None:
                ids.extend(self.v.encode(data))
            else:
                ids.append(t)
        return ids.tobytes()

    def __missing__(self, unit: str) -> bytes:
        ids = self.old.get(unit)
        if ids is None:
            ids = self.packed(" " + unit)
        if len(unit) < 100:
            if len(self) >= UNITS * self.share:
                self.old = dict(self)
                self.clear()
            self[unit] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        first, *rest = units(text or "") or [text]
        return np.frombuffer(b"".join([self.packed(first), *map(self.__getitem__, rest)]), np.int32)

    def rest(self) -> None:
        """Let go of the units, which known states soon give again: a worker
        that waits for its next task holds less."""
        self.clear()
        self.old = {}

    def decode(self, ids) -> bytes:
        return b"".join(map(self.v.tokens.__getitem__, ids))


def encoder(path: str, pattern: str, share: float = 1.0) -> Encoder:
    """One encoder per worker process and vocabulary, until another operator
    uses the process."""
    encoders, key = kept("bpe"), (path, pattern, share)
    if key not in encoders:
        encoders[key] = Encoder(read_ranks(path), pattern, share)
    return encoders[key]


def slices(batch: pa.RecordBatch):
    """The batch of (id, text) in slices of about ``SLICE`` bytes of text, a
    row at least; results weigh several times their text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + SLICE, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text", decoded: bool = True, share: float = 1.0) -> DataFrame:
    """(id, ids array<int>[, decoded binary]) for every row.  ``share`` of the
    bounds ``UNITS`` and ``STATES`` is what a worker's caches hold: less memory,
    more time.

    A null or empty text has no ids and decodes to no bytes; a null id and
    repeated rows are kept as they are; other columns are not read.
    ``decoded`` adds the bytes that the ids decode to.  ``path`` is the rank
    file, ``pattern`` the piece pattern; special tokens are not used."""
    ship_package(df.sparkSession)
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches):
        enc = encoder(path, pattern, share)
        for batch in chain.from_iterable(map(slices, batches)):
            rows = [enc.encode(t.as_py()) for t in batch.column(1)]
            ends = np.cumsum([0] + [len(r) for r in rows]).astype(np.int32)
            flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
            cols = [batch.column(0),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))]
            if decoded:
                cols.append(pa.array([enc.decode(r.tolist()) for r in rows], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=names)
        enc.rest()

    names = ["id", "ids"] + ["decoded"] * decoded
    out = src.mapInArrow(run, f"id {id_type}, ids array<int>" + ", decoded binary" * decoded)
    return out.withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
           ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary) of a table of ids (null ids: no bytes)."""
    ship_package(df.sparkSession)
    src = df.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches):
        enc = encoder(path, pattern)
        for batch in batches:
            found = [enc.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())],
                                             names=["id", "decoded"])

    return (src.mapInArrow(run, f"id {id_type}, decoded binary")
            .withColumnRenamed("id", id_col))


def digest(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Token count and digests of an ``encode(..., decoded=True)`` result."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(id_col, F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(ids, 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
