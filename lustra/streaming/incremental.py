"""Keeping a cache in step (an extension): a plan is a stateless projection, so it runs on streams
as it stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..functions import templates as tpl
from ..functions.templates import quoted
from ..model import CleaningPlan
from ..operators.sample import row_hash
from ..plans import compile as compiling

# Delete columns that are flags, whatever their type.
FLAGS = ("is_deleted", "soft_delete")


def append_only(spark: SparkSession, plan: CleaningPlan, source_dir: str, schema, out_dir: str, checkpoint: str) -> StreamingQuery:
    """Clean new files of a directory as they come, until none is left."""
    rows = spark.readStream.schema(schema).parquet(source_dir)
    clean = compiling.apply(plan, rows)
    return clean.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(rows: DataFrame, primary_key: str, updated: str, ties: list[Column] | None = None) -> DataFrame:
    """The last state of each key; of equal times the row that ``ties`` puts first (default: by the
    row's hash).  Rows without a time come last."""
    last = Window.partitionBy(quoted(primary_key)).orderBy(F.col(quoted(updated)).desc_nulls_last(), *(ties or []), row_hash(rows))
    return rows.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")


def deleted(rows: DataFrame, column: str) -> Column:
    """Whether a row is deleted: a flag (boolean, number or a word of a flag column) that is true, or
    a time (or its text) that is there.  Null is alive."""
    c, kind = F.col(quoted(column)), rows.schema[column].dataType
    if isinstance(kind, T.BooleanType):
        gone = c
    elif isinstance(kind, T.NumericType):
        gone = c != 0
    elif isinstance(kind, T.StringType):
        text = F.lower(F.trim(c))
        gone = text.isin(*tpl.TRUE_WORDS) if column.lower() in FLAGS else ~text.isin(*tpl.SENTINELS)
    else:
        gone = c.isNotNull()
    return F.coalesce(gone, F.lit(False))


def alive(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(~deleted(rows, column))


def merged(cache: DataFrame, changes: DataFrame, primary_key: str, updated: str, deleted_column: str | None = None) -> DataFrame:
    """upsert and delete_aware: changes over the cache, without deleted rows.  Of equal times a
    change wins over the cache.  Only keys that changed are compared; rows of other keys stay as
    they are, and so do rows of the cache without a key."""
    key = quoted(primary_key)
    touched = changes.select(key).distinct()
    both = cache.join(touched, primary_key, "left_semi").select(*[quoted(c) for c in cache.columns]).withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    out = cache.join(touched, primary_key, "left_anti").select(*[quoted(c) for c in cache.columns]).unionByName(latest(both, primary_key, updated, [F.col("_new").desc()]).drop("_new"))
    return alive(out, deleted_column) if deleted_column else out
