"""Where tables come from."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from . import database

#: Options of this module; the others go to the reader.
_OWN = ("schema", "parts")
FORMATS = ("parquet", "orc", "csv", "json", "jdbc", "table")


class TableNotFound(LookupError):
    pass


class UnsupportedSource(ValueError):
    pass


@dataclass(frozen=True)
class Source:
    """A place with tables: a directory of files, a catalog database or a JDBC address.

    For files, table ``t`` is ``<location>/t.<format>`` or ``<location>/t``.
    """

    location: str
    format: str = "parquet"
    primary_keys: tuple[tuple[str, str], ...] = ()
    options: tuple[tuple[str, str], ...] = ()

    def primary_key(self, table: str) -> str | None:
        return dict(self.primary_keys).get(table)

    def list_tables(self, spark: SparkSession) -> list[str]:
        """Sorted names; views don't count."""
        if self.format == "table":
            return sorted(t.name for t in spark.catalog.listTables(self.location) if t.tableType != "VIEW" and not t.isTemporary)
        if self.format == "jdbc":
            return sorted(t.name for t in self._reflected(spark))
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.location)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        ending = f".{self.format}"
        return sorted({n.removesuffix(ending) for n in names if n.endswith(ending)})

    def _reflected(self, spark: SparkSession) -> list[database.Table]:
        options = dict(self.options)
        return database.reflect(spark, self.location, {k: v for k, v in options.items() if k not in _OWN}, options.get("schema"))

    def with_keys(self, spark: SparkSession) -> "Source":
        """The source with the primary keys that the database itself knows; given ones win.  Keys of
        several columns don't count, as rows are told apart by one."""
        if self.format != "jdbc":
            return self
        known = {t.name: t.primary_key[0] for t in self._reflected(spark) if len(t.primary_key) == 1}
        return replace(self, primary_keys=tuple(sorted((known | dict(self.primary_keys)).items())))

    def _jdbc(self, spark: SparkSession, table: str) -> DataFrame:
        """Option ``schema`` names the tables' schema; with ``parts`` and a key the scan is split into
        ranges of like size."""
        options = dict(self.options)
        name = ".".join(database.quoted(spark, self.location, n) for n in (options.get("schema"), table) if n)
        plain = {k: v for k, v in options.items() if k not in _OWN}
        key = self.primary_key(table)
        if options.get("parts") and key:
            return database.read_in_ranges(spark, self.location, name, key, int(options["parts"]), plain)
        return spark.read.format("jdbc").option("url", self.location).option("dbtable", name).options(**plain).load()

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        """The table, lazily.  JDBC scans can be split, see :meth:`_jdbc`; Spark's own options
        partitionColumn, lowerBound, upperBound and numPartitions pass through."""
        if self.format not in FORMATS:
            raise UnsupportedSource(f"no reader for {self.format!r}")
        try:
            if self.format == "table":
                return spark.table(f"`{self.location}`.`{table}`")
            if self.format == "jdbc":
                return self._jdbc(spark, table)
            reader = spark.read.options(**dict(self.options))
            if self.format == "csv":
                reader = reader.option("header", "true")
            try:
                return reader.format(self.format).load(f"{self.location}/{table}.{self.format}")
            except AnalysisException:
                return reader.format(self.format).load(f"{self.location}/{table}")
        except AnalysisException as e:
            near = ", ".join(self.list_tables(spark)[:20]) if self.format != "jdbc" else ""
            raise TableNotFound(f"no table {table!r}; there are: {near}") from e
