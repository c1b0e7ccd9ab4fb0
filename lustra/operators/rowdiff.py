"""Changed rows between a source and its clean cache, a page at a time."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.templates import quoted
from .sample import row_hash


def _text(side: str, c: str) -> Column:
    return F.col(f"{side}.{quoted(c)}").cast("string")


def changed_rows(source: DataFrame, cache: DataFrame, key: str, place: bool = False) -> DataFrame:
    """_key, before__c, after__c and chg__c for each shared column, and changed_columns; only rows
    in which some text differs.  An inner equi-join on the key; Spark picks how.  With ``place`` the
    key is a row's place and no column of the table."""
    shared = [c for c in source.columns if c in cache.columns and not (place and c == key)]
    differs = {c: ~_text("s", c).eqNullSafe(_text("c", c)) for c in shared}
    joined = source.alias("s").join(cache.alias("c"), F.col(f"s.{quoted(key)}") == F.col(f"c.{quoted(key)}"))
    named = F.array_compact(F.array(*[F.when(d, F.lit(c)) for c, d in differs.items()]))
    out = [F.col(f"s.{quoted(key)}").alias("_key")]
    for c in shared:
        out += [_text("s", c).alias(f"before__{c}"), _text("c", c).alias(f"after__{c}"), differs[c].alias(f"chg__{c}")]
    return joined.select(*out, named.alias("changed_columns")).filter(F.size("changed_columns") > 0)


def with_position(df: DataFrame, order: list[Column] | None = None, path: str | None = None) -> DataFrame:
    """A position for tables without a key, by a stable order (default: the whole row).  Partitions
    are counted and numbered in two passes; with ``path`` the sorted rows are written there first, so
    that both see the same partitions."""
    keys = order or [F.col(quoted(c)).cast("string") for c in df.columns] + [row_hash(df)]
    parts = df.withColumn("_k", F.struct(*[k.alias(f"k{n}") for n, k in enumerate(keys)])).repartitionByRange("_k").sortWithinPartitions("_k")
    if path is not None:
        parts.withColumn("_mid", F.monotonically_increasing_id()).drop("_k").write.parquet(path)
        parts = df.sparkSession.read.parquet(path)
        placed = parts.withColumn("_part", F.shiftright("_mid", 33)).withColumn("_at", F.col("_mid").bitwiseAND((1 << 33) - 1)).drop("_mid")
    else:
        placed = parts.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    from pyspark.sql.window import Window

    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return placed.join(F.broadcast(first), "_part").withColumn("_position", F.col("_first") + F.col("_at")).drop("_k", "_part", "_at", "_n", "_first")


def unmatched_rows(source: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has (an extension: the diff itself shows rows of both)."""
    a = source.select(F.col(quoted(key)).alias("_key")).join(cache.select(F.col(quoted(key)).alias("_key")), "_key", "left_anti")
    b = cache.select(F.col(quoted(key)).alias("_key")).join(source.select(F.col(quoted(key)).alias("_key")), "_key", "left_anti")
    return a.withColumn("side", F.lit("removed")).unionByName(b.withColumn("side", F.lit("added")))


@dataclass
class DiffPage:
    total_changed: int
    page: int
    page_size: int
    rows: list[dict]
    types: dict[str, tuple[str | None, str | None]]
    dropped: list[str]
    added: list[str]


def column_types(source: DataFrame, cache: DataFrame) -> dict[str, tuple[str | None, str | None]]:
    a, b = dict(source.dtypes), dict(cache.dtypes)
    return {c: (a.get(c), b.get(c)) for c in dict.fromkeys([*a, *b])}


def json_value(v):
    """A value as JSON has it: numbers that aren't numbers are null, times and the rest are text."""
    if v is None or isinstance(v, (bool, int, str)):
        return v
    if isinstance(v, float):
        return v if math.isfinite(v) else None
    if isinstance(v, (list, tuple)):
        return [json_value(x) for x in v]
    return str(v)


def page_of(rows: list, total: int, source: DataFrame, cache: DataFrame, page: int, page_size: int) -> DiffPage:
    types = column_types(source, cache)
    plain = [{k: json_value(v) for k, v in r.asDict().items() if k != "_place"} for r in rows]
    return DiffPage(total, page, page_size, plain, types, [c for c, (_, b) in types.items() if b is None], [c for c, (a, _) in types.items() if a is None])


def diff_page(source: DataFrame, cache: DataFrame, key: str, page: int = 1, page_size: int = 50) -> DiffPage:
    """A page straight from the two tables, for one look: each page is a join of its own."""
    page, page_size = max(page, 1), page_size if page_size >= 1 else 50
    changed = changed_rows(source, cache, key)
    rows = changed.orderBy("_key").offset((page - 1) * page_size).limit(page_size).collect()
    return page_of(rows, changed.count(), source, cache, page, page_size)
