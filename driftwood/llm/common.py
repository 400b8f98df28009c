"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import re
import time

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.session import ensure_checkpoint_dir

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
#: The same separators as an explicit set, for splitting JVM-side.
SPACE = r"[\x20\x09-\x0D]+"

M1 = np.uint64(0xBF58476D1CE4E5B9)
M2 = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its
    lineage; the files outlive any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs now,
    instead of whenever the driver next collects its garbage; for after a
    ``cut`` of a step that moves about as much as the input."""
    gc.collect()
    time.sleep(1.5)  # released Python handles reach the JVM about once a second
    spark.sparkContext._jvm.System.gc()


#: What this worker process keeps between tasks, by owner.
_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """The caches that ``owner`` keeps in this worker process.  Spark reuses
    its workers for later jobs, so asking also frees what others have kept:
    a worker holds the caches of one operator at a time."""
    others = [o for o in _KEPT if o != owner]
    for other in others:
        _KEPT.pop(other).clear()
    if others:
        gc.collect()  # what refers to itself goes only so
    return _KEPT.setdefault(owner, {})


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of uint64 (wraps by design)."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes are split at exactly the ASCII
    white space that ``WORD`` leaves out."""
    return text.encode().split() if text else []


class WordHashes(dict):
    """word (UTF-8) -> 64-bit hash; emptied when it reaches ``bound``
    entries, so a worker's memory does not grow with the corpus vocabulary."""

    def __init__(self, bound: int = 300_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
