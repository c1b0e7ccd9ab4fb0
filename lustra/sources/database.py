"""Databases behind JDBC: what they hold, and scans in parts of like size.

Tables, columns and keys come from the driver's own metadata, which every dialect answers, and not
from views that only some of them have."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Relative error of the bounds of parts, in ranks: far below the share of any sensible number of parts.
ACCURACY = 100_000


class UnsupportedDatabase(ValueError):
    """There is no driver for the address, or it can't be reached."""


@dataclass(frozen=True)
class Table:
    schema: str | None
    name: str
    columns: tuple[tuple[str, str, bool], ...]  # name, the database's type, nullable
    primary_key: tuple[str, ...]


@contextmanager
def _connection(spark: SparkSession, url: str, options: dict[str, str]) -> Iterator:
    jvm = spark._jvm
    if not url.startswith("jdbc:"):
        raise UnsupportedDatabase(f"not a JDBC address: {url.split(':', 1)[0]}")
    try:
        if options.get("driver"):
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(options["driver"])
        properties = jvm.java.util.Properties()
        for k, v in options.items():
            properties.setProperty(k, v)
        connection = jvm.java.sql.DriverManager.getConnection(url, properties)
    except Exception as e:
        raise UnsupportedDatabase(f"no connection to {':'.join(url.split(':')[:2])}: {str(getattr(e, 'java_exception', e)).splitlines()[0][:200]}") from e
    try:
        yield connection
    finally:
        connection.close()


def _rows(result, *columns: str) -> list[tuple]:
    out = []
    while result.next():
        out.append(tuple(result.getString(c) for c in columns))
    result.close()
    return out


def reflect(spark: SparkSession, url: str, options: dict[str, str] | None = None, schema: str | None = None) -> list[Table]:
    """The tables of one schema, or of all that aren't the database's own; views don't count."""
    with _connection(spark, url, options or {}) as c:
        facts = c.getMetaData()
        kinds = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 1)
        kinds[0] = "TABLE"
        found = _rows(facts.getTables(c.getCatalog(), schema, "%", kinds), "TABLE_CAT", "TABLE_SCHEM", "TABLE_NAME")
        found = [r for r in found if schema is None or r[1] == schema]
        out = []
        for catalog, space, name in sorted(found, key=lambda r: (r[1] or "", r[2])):
            # Schema and table names are patterns here: what they match by chance is left out again.
            columns = _rows(facts.getColumns(catalog, space, name, "%"), "TABLE_SCHEM", "TABLE_NAME", "COLUMN_NAME", "TYPE_NAME", "NULLABLE", "ORDINAL_POSITION")
            mine = sorted((int(at), n, kind, null != "0") for s, t, n, kind, null, at in columns if (s, t) == (space, name))
            key = _rows(facts.getPrimaryKeys(catalog, space, name), "TABLE_SCHEM", "TABLE_NAME", "KEY_SEQ", "COLUMN_NAME")
            out.append(Table(space, name, tuple(x[1:] for x in mine), tuple(n for _, n in sorted((int(k), n) for s, t, k, n in key if (s, t) == (space, name)))))
    return out


def quoted(spark: SparkSession, url: str, name: str) -> str:
    """The name as the dialect quotes it."""
    return spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(name)


def _literal(value, kind: T.DataType) -> str:
    """The value in SQL; dates and times by JDBC's own escapes, which every driver reads."""
    if isinstance(kind, T.DateType):
        return f"{{d '{value}'}}"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return f"{{ts '{value}'}}"
    return repr(value) if isinstance(value, float) else str(value)


def key_ranges(keys: DataFrame, key: str, column: str, parts: int) -> list[str]:
    """Conditions that part a table by its key: ranges of like row counts, by the quantiles of the keys
    there are and not by equal steps, and nulls by themselves.  Each row meets exactly one.

    For numbers, dates and times.  A value that more rows share than a part should have is a part of
    its own; there may be fewer parts than asked for, as a part can't be less than one value."""
    kind = keys.schema[key].dataType
    if not isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise ValueError(f"{key} is {kind.simpleString()}: only numbers, dates and times are cut into ranges")
    shares = [k / parts for k in range(1, parts)]
    c = F.col(f"`{key}`")
    numbers = c if isinstance(kind, T.NumericType) else F.unix_date(c) if isinstance(kind, T.DateType) else F.unix_micros(c.cast("timestamp"))
    found = keys.agg(F.percentile_approx(numbers, shares, ACCURACY).alias("q")).first()["q"] if shares else []
    bounds = sorted(set(found or []))
    # A bound that takes in far more than its share starts a part before it as well.
    if bounds:
        n = keys.filter(c.isNotNull()).count()
        at = keys.select(numbers.alias("v")).filter(F.col("v").isin(bounds)).groupBy("v").agg(F.count("*").alias("n")).collect()
        heavy = {r["v"] for r in at if r["n"] * parts > n}
        step = 1 if isinstance(kind, (T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType)) else None
        if step:
            bounds = sorted({b for b in bounds} | {b + step for b in bounds if b in heavy} | {b for b in heavy})
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        back = F.date_from_unix_date(F.col("b").cast("int")) if isinstance(kind, T.DateType) else F.timestamp_micros("b")
        spark = keys.sparkSession
        bounds = [r[0] for r in spark.createDataFrame([(b,) for b in bounds], "b long").orderBy("b").select(back.cast("string")).collect()] if bounds else []
    said = [_literal(b, kind) for b in bounds]
    if not said:
        return [f"{column} IS NOT NULL", f"{column} IS NULL"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(said, said[1:])]
    return [f"{column} < {said[0]}", *inner, f"{column} >= {said[-1]}", f"{column} IS NULL"]


def read_in_ranges(spark: SparkSession, url: str, table: str, key: str, parts: int, options: dict[str, str] | None = None) -> DataFrame:
    """The table, one partition for each of :func:`key_ranges`.  The keys alone are read first."""
    options = options or {}
    column = quoted(spark, url, key)
    keys = spark.read.format("jdbc").options(**options).option("url", url).option("query", f"SELECT {column} FROM {table}").load()
    conditions = key_ranges(keys, keys.columns[0], column, parts)
    return spark.read.jdbc(url, table, predicates=conditions, properties=options)
