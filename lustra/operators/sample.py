"""A deterministic stratified sample: hash-ordered baseline, rows that reveal nulls, numeric extremes
and both ends of the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULTS, Settings
from ..functions.templates import quoted
from ..model import TableProfile
from ..sources.blocks import block_sample
from ..sources.snapshot import Snapshot
from .topk import Top, tops


def row_hash(df: DataFrame) -> Column:
    return F.md5(F.to_json(F.struct(*[F.col(quoted(c)) for c in df.columns]), {"ignoreNullFields": "false"}))


def hash_order(df: DataFrame, primary_key: str | None) -> list[Column]:
    """An order that has nothing to do with the values: by the key's MD5, or the row's."""
    own = F.md5(F.col(quoted(primary_key)).cast("string")) if primary_key else row_hash(df)
    return [own, row_hash(df)]


def baseline(df: DataFrame, primary_key: str | None, rows: int) -> DataFrame:
    return df.orderBy(*hash_order(df, primary_key)).limit(rows)


def null_rows(df: DataFrame, column: str, primary_key: str | None, rows: int) -> DataFrame:
    return df.filter(F.col(quoted(column)).isNull()).orderBy(*hash_order(df, primary_key)).limit(rows)


def boundaries(df: DataFrame, column: str, primary_key: str | None, rows: int) -> DataFrame:
    """Smallest and largest values, read as numbers."""
    n = F.col(quoted(column)).try_cast("double")
    known = df.filter(n.isNotNull())
    ties = hash_order(df, primary_key)
    return known.orderBy(n.asc(), *ties).limit(rows).union(known.orderBy(n.desc(), *ties).limit(rows))


def endpoints(df: DataFrame, primary_key: str, rows: int) -> DataFrame:
    k = F.col(quoted(primary_key))
    return df.orderBy(k.asc(), row_hash(df)).limit(rows).union(df.orderBy(k.desc(), row_hash(df)).limit(rows))


def first_rows(df: DataFrame, rows: int = DEFAULTS.first_rows, key: str | None = None) -> DataFrame:
    """The first rows by the key, if one is given; else some rows, as they come: no order, no full
    scan."""
    return (df.orderBy(quoted(key)) if key else df).limit(rows)


def page_sample(df: DataFrame, fraction: float = 0.01, seed: int = 42, rows: int = DEFAULTS.first_rows, snapshot: Snapshot | None = None) -> DataFrame:
    """A share of the rows, or the first rows where that share is empty.  With the table's snapshot whole
    blocks are drawn, and only these are read; else rows are drawn from a full scan."""
    some = block_sample(df.sparkSession, snapshot, fraction, seed) if snapshot is not None else None
    if some is None:
        some = df.sample(fraction=fraction, seed=seed)
    return some if some.head(1) else first_rows(df, rows)


def _short(md5: Column) -> Column:
    """The first 60 bits of a hash, which order as the hash does."""
    return F.conv(F.substring(md5, 1, 15), 16, 10).cast("long")


def _any_hash(df: DataFrame) -> Column:
    """A quick hash of the row, to tell rows of one key apart."""
    plain = lambda t: not any(x in t.simpleString() for x in ("map<", "variant"))
    return F.xxhash64(F.lit(len(df.columns)), *[F.col(quoted(f.name)) if plain(f.dataType) else F.to_json(F.struct(F.col(quoted(f.name)))) for f in df.schema.fields])


def strata(df: DataFrame, profile: TableProfile, settings: Settings = DEFAULTS) -> list[Top]:
    """Baseline, rows with nulls, numeric extremes and, with a key, its ends."""
    key = profile.primary_key
    own = F.coalesce(F.md5(F.col(quoted(key)).cast("string")), F.lit("")) if key else row_hash(df)
    ties = ((F.coalesce(_short(own), F.lit(-1).cast("long")), False), (_any_hash(df), False))
    out = [Top(settings.baseline_rows, ties)]
    out += [Top(settings.null_rows, ties, F.col(quoted(c.name)).isNull()) for c in profile.columns if c.null_pct > 0]
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType):
            n = F.col(quoted(f.name)).try_cast("double")
            out += [Top(settings.boundary_rows, ((n, falling), *ties), n.isNotNull()) for falling in (False, True)]
    if key:
        k = F.col(quoted(key))
        out += [Top(settings.boundary_rows, ((k, falling), *ties), k.isNotNull()) for falling in (False, True)]
    return out


def stratified(df: DataFrame, profile: TableProfile, settings: Settings = DEFAULTS) -> DataFrame:
    """Union of the strata, first occurrence wins, cut at the sample size.

    One scan, with a key or without one: tasks keep the first rows of each stratum, and what they
    kept is merged once.  Rows are told apart by key and content, without a key by content alone."""
    found = tops(df, strata(df, profile, settings))
    key = profile.primary_key
    own = F.coalesce(F.md5(F.col(quoted(key)).cast("string")), F.lit("")) if key else row_hash(df)
    row = F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("_row")
    marked = found.select("_rank", own.alias("_hash"), row_hash(df).alias("_whole"), row)
    first = marked.groupBy("_hash", "_whole").agg(F.min("_rank").alias("_rank"), F.first("_row").alias("_row"))
    return first.orderBy("_rank", "_hash", "_whole").limit(settings.sample_size).select("_row.*")


def value_ranks(values: DataFrame, n: int = 10) -> DataFrame:
    """(name, value, place) of the ``n`` first of each name's values (name, value, pos): longest,
    shortest, then those with punctuation, then by ``pos``.

    The longest and the shortest are two minima; of the others a name's first are kept in bounded
    lists, so that no task needs all values of a name."""
    odd = F.when(F.col("value").rlike("[^A-Za-z0-9]"), 0).otherwise(1)
    size = F.length("value")
    ends = values.groupBy("name").agg(F.min(F.struct((-size).alias("by"), "pos", "value")).alias("long"), F.min(F.struct(size.alias("by"), "pos", "value")).alias("short"))
    # Long and short may be one value, which then is the longest, and the next short one comes second.
    second = values.join(ends.select("name", F.col("long.value").alias("_long")), "name").filter("value <> _long")
    short = second.groupBy("name").agg(F.min(F.struct(size.alias("by"), "pos", "value")).alias("short"))
    ends = ends.select("name", F.col("long.value").alias("_long")).join(short.select("name", F.col("short.value").alias("_short")), "name", "left")
    names = [r["name"] for r in ends.select("name").collect()]  # columns of a table
    rest = tops(values, [Top(n + 2, ((odd, False), (F.col("pos"), False), (F.col("value"), False)), F.col("name") == name) for name in names]) if names else values.withColumn("_rank", F.lit(0))
    rest = rest.join(ends, "name").filter("value <> _long and not value <=> _short").select("name", F.struct(F.lit(2).alias("tier"), odd.alias("odd"), "pos", "value").alias("at"))
    lead = ends.select("name", F.explode(F.array(F.struct(F.lit(0).alias("tier"), F.col("_long").alias("value")), F.struct(F.lit(1).alias("tier"), F.col("_short").alias("value")))).alias("x"))
    lead = lead.filter("x.value is not null").select("name", F.struct(F.col("x.tier").alias("tier"), F.lit(0).alias("odd"), F.lit("").alias("pos"), F.col("x.value").alias("value")).alias("at"))
    # At most n + 4 rows of each name.
    listed = rest.unionByName(lead).groupBy("name").agg(F.array_sort(F.collect_list("at")).alias("at"))
    placed = listed.select("name", F.posexplode("at").alias("place", "at")).select("name", "at.value", (F.col("place") + 1).alias("place"))
    return placed.filter(F.col("place") <= n)


def diverse_values(sample: DataFrame, columns: list[str], n: int) -> dict[str, list[str]]:
    """A few telling values of each column."""
    if not columns:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(quoted(c)).cast("string").alias("value")) for c in columns]))
    values = sample.select(pairs.alias("p")).select("p.*").filter("value is not null")
    values = values.groupBy("name", "value").agg(F.min(F.md5("value")).alias("pos"))
    out: dict[str, list[str]] = {}
    for r in value_ranks(values, n).orderBy("name", "place").collect():
        out.setdefault(r["name"], []).append(r["value"])
    return out
