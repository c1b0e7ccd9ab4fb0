"""A table's rows as they were at one moment.

Files are pinned by name, size and time of change in a manifest; later reads see these files and no
others, and fail if one is gone or was rewritten.  A source without files, or whose rows can't be
told apart, is copied once as Parquet, and its copy is pinned.

Rows of Parquet files have a place: the file's first number (rows of all files before it, by name)
and the row's index in the file.  It is the same in every read, whatever the splits.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .files import Files
from .tables import Source


class SourceChanged(RuntimeError):
    """Files of a snapshot are gone or were rewritten."""


@dataclass(frozen=True)
class Snapshot:
    folder: str  # the manifest, and the copy if there is one
    format: str
    schema: str  # as JSON
    options: tuple[tuple[str, str], ...]
    rows: int | None  # known where rows have places
    base: str | None = None  # the folder above partition folders

    @staticmethod
    def of(raw: dict) -> "Snapshot":
        return Snapshot(**raw | {"options": tuple(map(tuple, raw["options"]))})

    def manifest(self, spark: SparkSession) -> DataFrame:
        """path, file (as Spark's metadata spell it), size, changed, rows, first: one row for each file."""
        return spark.read.parquet(f"{self.folder}/manifest")

    def check(self, spark: SparkSession) -> list[str]:
        """The files' paths, if all are as they were."""
        then = {r["path"]: (r["size"], r["changed"]) for r in self.manifest(spark).select("path", "size", "changed").collect()}
        try:
            now = {r["path"]: (r["size"], r["changed"]) for r in _listed(spark, list(then)).collect()}
        except AnalysisException as e:
            raise SourceChanged(f"files of the snapshot are gone: {str(e).splitlines()[0][:300]}") from e
        other = sorted(p for p, x in then.items() if now.get(p) != x)
        if other:
            raise SourceChanged(f"{len(other)} files changed since the snapshot, first {other[0]}")
        return sorted(then)

    def empty(self, spark: SparkSession) -> DataFrame:
        """No rows, but the columns."""
        return spark.createDataFrame([], T.StructType.fromJson(json.loads(self.schema)))

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows, lazily; files that came later don't count."""
        return self.only(spark, self.check(spark))

    def only(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        """The rows of some of the files."""
        if not paths:
            return self.empty(spark)
        reader = spark.read.format(self.format).options(**dict(self.options)).schema(self.empty(spark).schema)
        if self.base:
            reader = reader.option("basePath", self.base)
        return reader.load([_literal(p) for p in paths])

    def numbered(self, spark: SparkSession, name: str) -> DataFrame:
        """The rows with their place, from 0, in column ``name``.  One number for each file is joined;
        no row is moved if that many fit a broadcast."""
        if self.rows is None:
            raise ValueError("rows of this snapshot have no places")
        df = self.read(spark)
        if not self.rows:
            return df.withColumn(name, F.lit(None).cast("long"))
        first = self.manifest(spark).select(F.col("file").alias("_file"), F.col("first").alias("_first"))
        placed = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_at"))
        return placed.join(first, F.col("_path") == F.col("_file")).withColumn(name, F.col("_first") + F.col("_at")).drop("_path", "_at", "_file", "_first")


def _literal(path: str) -> str:
    """The path with pattern characters escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, file, size, changed of files, from their listing; nothing is read."""
    if not paths:
        return spark.createDataFrame([], "path string, file string, size long, changed timestamp")
    found = spark.read.format("binaryFile").load([_literal(p) for p in paths])
    return found.select("path", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("changed"))


def _has_places(df: DataFrame) -> bool:
    try:
        df.select("_metadata.row_index")
        return True
    except AnalysisException:
        return False


def _decoded(spark: SparkSession, files: list[str]) -> list[str]:
    """Paths of file addresses."""
    jvm = spark._jvm
    return [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).toString() for f in files]


def take(spark: SparkSession, source: Source, table: str, folder: str) -> Snapshot:
    """Pin a table.  Parquet files are pinned as they are; other files too where a primary key tells
    rows apart; all else is copied to ``folder``."""
    df = source.read(spark, table)
    files = _decoded(spark, df.inputFiles())
    places = bool(files) and _has_places(df)
    kind, options = ("parquet", ()) if source.format in ("jdbc", "table") or places else (source.format, source.options)
    if source.format == "csv":
        options = (("header", "true"), *options)
    if not places and not (files and source.format != "table" and source.primary_key(table)):
        df.write.parquet(f"{folder}/rows")
        df, kind, options, places = spark.read.parquet(f"{folder}/rows"), "parquet", (), True
        files = _decoded(spark, df.inputFiles())
    listed = _listed(spark, files)
    if places:
        counts = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows")) if files else spark.createDataFrame([], "file string, rows long")
        listed = listed.join(counts, "file", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
        # One row for each file.
        before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
        listed = listed.withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    listed.coalesce(1).write.parquet(f"{folder}/manifest")
    rows = spark.read.parquet(f"{folder}/manifest").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] if places else None
    parted = re.match(r"(.*?)/[^/=]+=[^/]*/", files[0]) if files else None
    return Snapshot(folder, kind, df.schema.json(), options, rows, parted and parted[1])


def drop(spark: SparkSession, snapshot: Snapshot) -> None:
    """Forget a snapshot, and its copy if there is one."""
    Files(spark).remove(snapshot.folder)


def fresh(folder: str) -> str:
    return f"{folder}/{uuid.uuid4().hex[:12]}"
