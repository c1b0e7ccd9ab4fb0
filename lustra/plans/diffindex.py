"""Changed rows of one cache version, written once in the order of their keys.

Files hold a bounded number of rows, and a small index says how many each one has.  A page opens the
file or two that hold it, whatever its number, and the total is read from the index."""

from __future__ import annotations

import json
import re
import uuid
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.files import Files

#: Most rows of a file.
ROWS = 100_000


class DiffIndex:
    """The index ``<path>.json`` is written last, by a rename, and names the folder it describes; who
    reads it sees a whole index or none."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, Files(spark)
        self.index: dict | None = None

    def load(self) -> bool:
        """Whether there is an index."""
        if self.index is None:
            text = self.files.read(f"{self.path}.json")
            self.index = json.loads(text) if text is not None else None
        return self.index is not None

    def build(self, changed: DataFrame, rows: int = ROWS) -> None:
        """Write ``changed`` by its column _key, which needn't be unique."""
        folder = f"{self.path}/{uuid.uuid4().hex[:12]}"
        changed.orderBy("_key").write.option("maxRecordsPerFile", rows).parquet(folder)
        written = self.spark.read.schema(changed.schema).parquet(folder)
        # A row for each file.
        found = written.groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("n")).collect()

        def place(r: Row) -> tuple[int, int]:
            part, more = re.match(r"part-(\d+)-.*-c(\d+)\.", r["name"]).groups()
            return int(part), int(more)

        files = [(r["name"], r["n"]) for r in sorted(found, key=place)]
        self.index = {"folder": folder, "total": sum(n for _, n in files), "files": files, "schema": changed.schema.json()}
        self.files.replace(f"{self.path}.json", json.dumps(self.index))

    @property
    def total(self) -> int:
        return self.index["total"]

    def _schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.index["schema"]))

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(self._schema()).parquet(*[f"{self.index['folder']}/{n}" for n in names])

    def rows(self) -> DataFrame:
        """All changed rows."""
        names = [n for n, _ in self.index["files"]]
        return self._read(names) if names else self.spark.createDataFrame([], self._schema())

    def slice(self, start: int, size: int) -> DataFrame | None:
        """Rows ``start`` to ``start + size`` in the order of their keys; None beyond the end."""
        ends = list(accumulate(n for _, n in self.index["files"]))
        stop = min(start + size, self.total)
        if start >= stop:
            return None
        wanted = range(bisect_right(ends, start), bisect_right(ends, stop - 1) + 1)
        names = [self.index["files"][k][0] for k in wanted]
        first = F.element_at(F.create_map(*[F.lit(x) for k, n in zip(wanted, names) for x in (n, ends[k] - self.index["files"][k][1])]), F.col("_metadata.file_name"))
        place = first + F.col("_metadata.row_index")
        return self._read(names).withColumn("_place", place).filter((F.col("_place") >= start) & (F.col("_place") < stop))

    def page(self, number: int, size: int) -> list[Row]:
        found = self.slice((number - 1) * size, size)
        return [] if found is None else sorted(found.collect(), key=lambda r: r["_place"])
