"""Exact duplicates by Patricia tries whose terminal nodes know their owner.

Texts that are equal after lower-casing A-Z are one text.  Every normalised
text is inserted, byte by byte as UTF-8, into the compressed radix trie of its
partition: its length in bytes and ``bits`` bits of a content hash.  A text's
terminal node holds the owner (the largest or the smallest id seen) and the
number of rows; different texts that share length and hash end in different
terminals, so equality is decided by bytes and never by the hash.

1. Each task inserts its own rows and hands on one row per terminal, so a text
   that a third of all rows hold leaves a task once.  When its tries hold more
   than ``BUDGET`` bytes, the largest subtrees go out as they are (their texts
   come together again in step 2).
2. The rows are dealt by partition and sorted by (length, hash, text).  In that
   order every subtree that the last insertion did not pass is complete, so a
   trie over the budget spills all its complete subtrees as final owners; what
   stays is one path.  A partition that holds more than 1 / ``HOT`` of the rows
   is dealt by a salt as well; its few owners go through a second round.
3. Owners come back to the rows by (length, hash, SHA-256), narrow rows without
   texts.  There are at most ``HOT`` hot partitions, whatever the input: rows of
   those are joined by broadcast, so no task holds a hot group.

Defined cases: null texts are empty texts, and equal to them.  Ids may be of
any type that orders; an id that several rows share owns as any other.  Rows
without an id own nothing, unless no row of their group has one: then the
owner is null and all its rows are kept.  Otherwise a row is kept if its id is
the owner's.  ``group_size`` counts rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.llm.common import cut, partitions
from driftwood.session import ship_package

#: Bytes that the tries of a task hold at most before subtrees are spilled.
BUDGET = 64 << 20
#: A partition is hot above this share (1 / HOT) of all rows; so at most HOT are.
HOT = 10_000
#: Tasks that share a hot partition in the first round.
SALTS = 16
#: Bytes that a node takes beside its label, about.
NODE = 200


class Node:
    """A branch of a compressed radix trie: the bytes that lead to it, its
    children by their first byte, and the owner if a text ends here."""

    __slots__ = ("label", "children", "owner", "count")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner, self.count = label, {}, None, 0


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix: by halves, so that comparing is C's work."""
    if a == b:
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


class Patricia:
    """A compressed radix trie of byte strings; ``better`` picks the owner."""

    def __init__(self, better=max):
        self.root, self.size, self.better = Node(b""), 0, better

    def insert(self, text: bytes, owner, count: int = 1) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:] if at else text)
                self.size += NODE + len(child.label)
                node, at = child, len(text)
                break
            rest = text[at:] if at else text
            n = common(child.label, rest)
            if n < len(child.label):  # the edge parts here
                split = node.children[text[at]] = Node(child.label[:n])
                child.label = child.label[n:]
                split.children[child.label[0]] = child
                self.size += NODE
                child = split
            node, at = child, at + n
        node.count += count
        if owner is not None:
            node.owner = owner if node.owner is None else self.better(node.owner, owner)

    def terminals(self, node: Node | None = None, before: bytes = b"") -> Iterator[tuple]:
        """(text, owner, count) below a node, in byte order."""
        stack = [(node or self.root, before)]
        while stack:
            n, prefix = stack.pop()
            text = prefix + n.label
            if n.count:
                yield text, n.owner, n.count
            stack.extend((n.children[k], text) for k in sorted(n.children, reverse=True))

    def weight(self, node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            n = stack.pop()
            total += NODE + len(n.label)
            stack.extend(n.children.values())
        return total

    def spill(self, keep: bytes | None = None) -> Iterator[tuple]:
        """Take subtrees out and yield their terminals.  With ``keep`` (sorted
        input) all that lie off its path; else the largest below the root,
        until half of the size is gone."""
        if keep is not None:
            node, at = self.root, 0
            while at < len(keep):
                on = node.children[keep[at]]
                if node.count:  # a text that ends on the path comes before keep
                    yield keep[:at], node.owner, node.count
                    node.count, node.owner = 0, None
                for k in sorted(node.children):
                    if node.children[k] is not on:
                        self.size -= self.weight(node.children[k])
                        yield from self.terminals(node.children.pop(k), keep[:at])
                node, at = on, at + len(on.label)
            return
        node, before = self.root, b""
        while len(node.children) == 1 and not node.count:  # go down to the first fork
            node = next(iter(node.children.values()))
            before += node.label
        goal = self.size // 2
        for size, k in sorted(((self.weight(c), k) for k, c in node.children.items()), reverse=True):
            yield from self.terminals(node.children.pop(k), before)
            self.size -= size
            if self.size <= goal:
                return
        if node.count:
            yield before, node.owner, node.count
            node.count, node.owner = 0, None


class Tries:
    """The tries of a task, one per partition; together at most ``budget``
    bytes, beyond which whole tries and then subtrees are spilled."""

    def __init__(self, better, budget: int):
        self.better, self.budget, self.tries, self.size = better, budget, {}, 0

    def insert(self, key: tuple, text: bytes, owner, count: int) -> None:
        trie = self.tries.get(key)
        if trie is None:
            trie = self.tries[key] = Patricia(self.better)
            self.size += NODE
        before = trie.size
        trie.insert(text, owner, count)
        self.size += trie.size - before

    def over(self) -> Iterator[tuple]:
        """(key, text, owner, count) of what has to go, the oldest tries first
        (those of equal texts far apart come together again later)."""
        goal = self.budget // 2 if self.size > self.budget else self.size
        while self.size > goal and len(self.tries) > 1:
            key = next(iter(self.tries))
            trie = self.tries.pop(key)
            self.size -= trie.size + NODE
            yield from ((key, *t) for t in trie.terminals())
        while self.size > goal:
            (key, trie), = self.tries.items()
            before = trie.size
            yield from ((key, *t) for t in trie.spill())
            self.size -= before - trie.size
            if trie.size == before:
                return

    def rest(self) -> Iterator[tuple]:
        for key, trie in self.tries.items():
            yield from ((key, *t) for t in trie.terminals())
        self.tries, self.size = {}, 0


def normalised(text: pa.Array) -> pa.Array:
    """Texts with only A-Z lower-cased; null is the empty text."""
    return pc.ascii_lower(pc.fill_null(text, ""))


def content_hash(text: bytes, bits: int) -> int:
    h = xxhash.xxh3_64_intdigest(text) >> (64 - bits)
    return h - (1 << 64) if h >= 1 << 63 else h


def batches_of(rows: Iterator[tuple], schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """(key, text, owner, count) tuples as record batches of bounded bytes."""
    held, size = [], 0
    for (length, h, salt), text, owner, count in rows:
        held.append((length, h, salt, text, owner, count))
        size += len(text) + 64
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def prints(docs: DataFrame, bits: int) -> DataFrame:
    """(id, length, hash, sha) of every (id, text) row."""
    def run(batches):
        for batch in batches:
            texts = [t.as_py().encode() for t in normalised(batch.column(1))]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(map(len, texts), pa.int32()),
                pa.array((content_hash(t, bits) for t in texts), pa.int64()),
                pa.array((hashlib.sha256(t).digest() for t in texts), pa.binary())],
                names=["id", "length", "hash", "sha"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, length int, hash long, sha binary")


def task_owners(docs: DataFrame, bits: int, better, budget: int) -> DataFrame:
    """(length, hash, salt, text, owner, n): the terminals of each task."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        schema = None

        def rows():
            nonlocal schema
            tries = Tries(better, budget)
            for batch in batches:
                schema = schema or owner_schema(batch.schema.field(0).type)
                for id_, t in zip(batch.column(0).to_pylist(), normalised(batch.column(1))):
                    text = t.as_py().encode()
                    tries.insert((len(text), content_hash(text, bits), 0), text, id_, 1)
                    if tries.size > budget:
                        yield from tries.over()
            yield from tries.rest()

        found = rows()
        first = next(found, None)
        if first is not None:
            yield from batches_of(chain_one(first, found), schema)

    return docs.mapInArrow(run, f"length int, hash long, salt int, text binary, owner {kind}, n long")


def owner_schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("length", pa.int32()), ("hash", pa.int64()), ("salt", pa.int32()), ("text", pa.binary()),
                      ("owner", id_type), ("n", pa.int64())])


def chain_one(first, rest: Iterator) -> Iterator:
    yield first
    yield from rest


def merged(rows: DataFrame, better, budget: int) -> DataFrame:
    """Terminals of the same partition (and salt) put into one trie.  Rows
    come sorted, so a partition is done when the next one starts."""
    id_type = rows.schema["owner"].dataType.simpleString()
    n = partitions(rows.sparkSession)
    dealt = rows.repartition(n, "length", "hash", "salt").sortWithinPartitions("length", "hash", "salt", "text")

    def run(batches):
        schema = None

        def all_terminals():
            nonlocal schema
            trie, now = Patricia(better), None
            for batch in batches:
                schema = schema or owner_schema(batch.schema.field(4).type)
                for length, h, salt, text, owner, count in zip(*(c.to_pylist() for c in batch.columns)):
                    if (length, h, salt) != now:
                        if now is not None:
                            yield from ((now, *t) for t in trie.terminals())
                        trie, now = Patricia(better), (length, h, salt)
                    trie.insert(text, owner, count)
                    if trie.size > budget:
                        yield from ((now, *t) for t in trie.spill(keep=text))
            if now is not None:
                yield from ((now, *t) for t in trie.terminals())

        found = all_terminals()
        first = next(found, None)
        if first is not None:
            yield from batches_of(chain_one(first, found), schema)

    return dealt.mapInArrow(run, f"length int, hash long, salt int, text binary, owner {id_type}, n long")


def owners(docs: DataFrame, hot: DataFrame, keep: str, bits: int, budget: int, salts: int) -> DataFrame:
    """(length, hash, sha, owner, n): a row per distinct text."""
    better = max if keep == "largest" else min
    salt = F.when(F.col("is_hot"), F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(F.lit(0))
    rows = task_owners(docs, bits, better, budget) \
        .join(F.broadcast(hot.select("length", "hash", F.lit(True).alias("is_hot"))), ["length", "hash"], "left") \
        .select("length", "hash", salt.cast("int").alias("salt"), "text", "owner", "n", "is_hot")
    flagged = rows.withColumn("salt", F.when(F.col("is_hot"), F.col("salt") + 1).otherwise(F.col("salt")))
    once = merged(flagged.drop("is_hot"), better, budget)
    # texts of hot partitions (salt > 0) are few by now: carry only those on
    named = cut(once.select("length", "hash", "salt", F.sha2("text", 256).alias("sha"), "owner", "n",
                            F.when(F.col("salt") > 0, F.col("text")).alias("text")))
    again = merged(named.where("salt > 0").select("length", "hash", F.lit(0).alias("salt"), "text", "owner", "n"),
                   better, budget)
    out = ["length", "hash", "sha", "owner", "n"]
    return named.where("salt = 0").select(out).unionByName(
        again.select("length", "hash", F.sha2("text", 256).alias("sha"), "owner", "n").select(out))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest",
                     bits: int = 64, budget: int = BUDGET, hot: int = HOT, salts: int = SALTS) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) per row; ``keep`` says
    whether the ``largest`` or the ``smallest`` id owns a text."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    if not 1 <= bits <= 64:
        raise ValueError("bits is from 1 to 64")
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    members = cut(prints(rows, bits))
    total = members.count()
    crowded = cut(members.groupBy("length", "hash").agg(F.count("*").alias("rows"))
                  .where(F.col("rows") * hot > total).where("rows > 1"))
    found = cut(owners(rows, crowded, keep, bits, budget, salts))
    members = members.withColumn("sha", F.lower(F.hex("sha")))
    key = ["length", "hash", "sha"]
    flag = crowded.select("length", "hash")
    warm = members.join(F.broadcast(flag), ["length", "hash"], "left_anti").join(found, key)
    # distinct texts of the hot partitions, by how many rows they hold: at most ``hot``
    # again have more than their share; the others are dealt by text
    big = found.where(F.col("n") * hot > total)
    small = found.where(F.col("n") * hot <= total)
    held = members.join(F.broadcast(flag), ["length", "hash"], "left_semi")
    in_big = held.join(F.broadcast(big), key)
    in_small = held.join(F.broadcast(big.select(key)), key, "left_anti").join(small, key)
    every = warm.unionByName(in_big).unionByName(in_small)
    kept = F.when(F.col("owner").isNull(), F.lit(True)).otherwise(F.coalesce(F.col("id") == F.col("owner"), F.lit(False)))
    return every.select(F.col("id").alias(id_col), F.col("owner").alias("keep_id"),
                        F.col("n").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))


EXACT_SQL = r"""
WITH t AS (
  SELECT doc_id, translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
g AS (SELECT t, MAX(doc_id) AS keep_id, COUNT(*) AS group_size FROM t GROUP BY t)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size,
       COALESCE(doc_id = keep_id, keep_id IS NULL) AS kept, sha256(t.t) AS text_sha256
FROM t JOIN g ON t.t = g.t
"""
