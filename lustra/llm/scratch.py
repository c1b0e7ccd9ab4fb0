"""Tables written to cut lineage, and global ranks.

Everything goes to a folder of this process in the one that the cluster names in
``spark.checkpoint.dir``.  A temporary folder is used only where that setting is absent and the
master is local (tests, a single machine).

A table belongs to the call that wrote it: the call deletes with :func:`discard` what its result
doesn't read, and nothing else deletes tables.  What a lazy result still reads stays until the
session's JVM ends, and is deleted then.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []
_folders: dict[str, str] = {}
_path_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@atexit.register
def _remove_own() -> None:
    for path in _own:
        shutil.rmtree(path, ignore_errors=True)


def _shared_folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lustra-"))
    return _own[0]


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def folder(spark: SparkSession) -> str:
    """This session's folder for intermediate tables; it goes when the session's JVM ends."""
    key = f"{spark.sparkContext.applicationId}|{_shared_folder(spark)}"
    if key not in _folders:
        path = f"{_shared_folder(spark)}/lustra-{uuid.uuid4().hex}"
        files, where = _hadoop(spark, path)
        files.mkdirs(where)
        files.deleteOnExit(where)
        _folders[key] = path
    return _folders[key]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a cut in the lineage that
    outlives any executor.  The shuffle files of the write are deleted with its end, as nothing
    reads them any more."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _path_of[table] = path
    passing = _passing.get()
    if passing is not None:
        passing.append(path)
    return table


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`written` makes inside are deleted at the end.  What reads them has to be
    written itself by then."""
    paths: list[str] = []
    before = _passing.set(paths)
    try:
        yield
    finally:
        _passing.reset(before)
        for path in paths:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    files, where = _hadoop(spark, path)
    files.delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` returned; a second time is of no effect.  Only once
    everything that reads them has been written itself."""
    for table in tables:
        path = _path_of.pop(table, None)
        if path is not None:
            remove(table.sparkSession, path)


def ranked(df: DataFrame, order: list[Column], name: str, into: str = "rank") -> DataFrame:
    """Add the 0-based position of each row in the global order of ``order``.

    ``order`` is ascending, nulls first.  A range shuffle, a sort in each partition and a count for each partition; no task sees all
    rows.  Give an ``order`` without long ties, as rows of equal keys share a partition.  Only one
    number for each partition is broadcast.
    """
    keys = [f"_k{i}" for i in range(len(order))]
    rows = df.select("*", *[c.alias(k) for c, k in zip(order, keys)])
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    rows = written(rows.withColumn("_mid", F.monotonically_increasing_id()), name)
    part = F.shiftright("_mid", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    at = rows.withColumn("_part", part).join(F.broadcast(first), "_part")
    return at.withColumn(into, F.col("_first") + F.col("_mid").bitwiseAND((1 << 33) - 1)).drop("_mid", "_part", "_first")
