"""A run table that is stored and changed in place.

Layout: ``<path>/v-<number>/batch=<id>/*.parquet``.  The folder with the largest
number is the table; each batch of appended runs is a partition of it.

* ``append`` writes one batch with dynamic partition overwrite: replaying it
  replaces its own partition and adds nothing.
* ``remove_recent`` writes the remaining runs to a staging folder and makes that
  the next version by one rename, which fails if another writer was first.  A
  reader sees the old table or the new one, never a part; a job that fails
  half-way leaves only a staging folder, which nobody reads.

Readers that have started on a version keep it: old versions stay until
``drop_old`` removes them.  One writer at a time; readers as many as you like.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.operators import runs as R

VERSION = re.compile(r"^v-(\d{6,})$")


def _files(spark: SparkSession, path: str):
    """(file system, path object) of the store's folder."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the published versions, ascending."""
    fs, folder = _files(spark, path)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
    return sorted(int(m.group(1)) for m in map(VERSION.match, names) if m)


def _folder(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/v-{version:06d}"


def read_runs(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The stored runs: of the latest version, or of an older one."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise ValueError(f"no runs stored in {path!r}" if not known else f"no version {version} in {path!r}")
    return (spark.read.option("mergeSchema", "true").parquet(_folder(path, known[-1] if version is None else version))
            .drop("batch"))


def append(new_runs: DataFrame, path: str, batch: str) -> None:
    """Store ``new_runs`` as the batch of that name; the same batch again takes
    its own place.  Columns that stored runs lack are null there, and the other
    way round."""
    if not batch or re.search(r"[^\w.-]", batch):
        raise ValueError("a batch is named by letters, digits, _, - and .")
    known = versions(new_runs.sparkSession, path)
    (new_runs.withColumn("batch", F.lit(batch)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch")
     .parquet(_folder(path, known[-1] if known else 1)))


def publish(runs: DataFrame, path: str, after: int) -> int:
    """Make ``runs`` (with its ``batch`` column) the version after ``after``:
    written aside first, then renamed.  Raises if that version is there."""
    spark = runs.sparkSession
    fs, _ = _files(spark, path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    staging, target = f"{path.rstrip('/')}/_staging-{uuid.uuid4().hex}", _folder(path, after + 1)
    runs.write.partitionBy("batch").parquet(staging)
    if fs.exists(place(target)) or not fs.rename(place(staging), place(target)):
        fs.delete(place(staging), True)
        raise RuntimeError(f"version {after + 1} of {path!r} was published by another writer")
    return after + 1


def remove_recent(spark: SparkSession, path: str, experiment: str, count: int) -> int:
    """Publish the table without the ``count`` latest runs of an experiment;
    returns its version."""
    known = versions(spark, path)
    if not known:
        raise ValueError(f"no runs stored in {path!r}")
    stored = spark.read.option("mergeSchema", "true").parquet(_folder(path, known[-1]))
    return publish(R.remove_recent_runs(stored, experiment, count), path, known[-1])


def drop_old(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Remove all but the latest ``keep`` versions; returns those removed."""
    if keep < 1:
        raise ValueError("at least the current version is kept")
    fs, _ = _files(spark, path)
    gone = versions(spark, path)[:-keep]
    for v in gone:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(path, v)), True)
    return gone
