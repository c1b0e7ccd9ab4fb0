"""Sampling by blocks: whole files and row groups are drawn, and only these are read.

Where a table has many files, a file is a block: the files drawn are read by Spark as usual.  Where it
has few, Parquet row groups are blocks: a Python data source opens each file, draws row groups by a
hash of seed, file and number, and reads these alone.  The same seed draws the same blocks, whatever
the order or the splits."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .snapshot import Snapshot

#: From so many files in the sample on, a file is a block.
FILES = 50


def drawn(seed: int, fraction: float, *what: object) -> bool:
    """Whether a block belongs to the sample."""
    digest = hashlib.blake2b(repr((seed, *what)).encode(), digest_size=8).digest()
    return int.from_bytes(digest, "big") < fraction * 2**64


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _opened(path: str):
    """The file for pyarrow; its own file systems are used, by the address's scheme."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return system.open_input_file(inner)


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.names = schema.fieldNames()
        self.paths, self.seed, self.fraction = json.loads(options["paths"]), int(options["seed"]), float(options["fraction"])
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema = to_arrow_schema(schema)

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        with _opened(partition.path) as source:
            found = pq.ParquetFile(source)
            groups = [k for k in range(found.num_row_groups) if drawn(self.seed, self.fraction, partition.path.rsplit("/", 1)[-1], k)]
            if groups:
                for batch in found.iter_batches(row_groups=groups, columns=self.names):
                    yield from pa.Table.from_batches([batch]).select(self.names).cast(self.schema).to_batches()


class RowGroups(DataSource):
    """Row groups of Parquet files: options paths (JSON), seed and fraction."""

    @classmethod
    def name(cls) -> str:
        return "lustra_row_groups"

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(schema, dict(self.options))


def block_sample(spark: SparkSession, snapshot: Snapshot, fraction: float, seed: int = 42) -> DataFrame | None:
    """The rows of the blocks drawn; None where a table's blocks can't be read apart (other formats than
    Parquet, partition folders, stores that only Spark's readers open)."""
    paths = snapshot.check(spark)
    if len(paths) * fraction >= FILES:
        return snapshot.only(spark, [p for p in paths if drawn(seed, fraction, p.rsplit("/", 1)[-1])])
    if snapshot.format != "parquet" or snapshot.base or not paths:
        return None
    try:
        for p in paths[:1]:
            _opened(p).close()
    except Exception:
        return None
    spark.dataSource.register(RowGroups)
    schema = snapshot.empty(spark).schema
    return spark.read.format("lustra_row_groups").schema(schema).options(paths=json.dumps(paths), seed=seed, fraction=fraction).load()
