"""The first rows of several orders, in one scan.

Each task keeps a bounded heap for each order and hands on what is left at its end; one shuffle by
order brings these together, and the same heaps merge them.  No task holds more than the rows asked
for and one batch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Top:
    """The first ``rows`` rows of those with ``where``, by ``order``; (column, True) is descending.
    Order columns must not be null where ``where`` holds."""

    rows: int
    order: tuple[tuple[Column, bool], ...]
    where: Column | None = None


def _heaps(plans: list[tuple[int, str | None, list[tuple[str, str]]]], merge: bool):
    """Keep the first rows of each plan: (rows, column of the condition, sort keys)."""

    def first(rows: pa.Table, plan: tuple) -> pa.Table:
        if not rows.num_rows:
            return rows
        return rows.take(pc.select_k_unstable(rows, min(plan[0], rows.num_rows), plan[2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[pa.Table | None] = [None] * len(plans)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            ranks = pc.unique(batch.column("_rank")).to_pylist() if merge else range(len(plans))
            for k in ranks:
                condition = pc.equal(rows["_rank"], k) if merge else rows[plans[k][1]] if plans[k][1] else None
                mine = first(rows if condition is None else rows.filter(condition), plans[k])
                if mine.num_rows:
                    heap = heaps[k]
                    heaps[k] = first(pa.concat_tables([heap, mine]), plans[k]) if heap is not None else mine
        for k, heap in enumerate(heaps):
            if heap is not None:
                if not merge:
                    heap = heap.append_column(pa.field("_rank", pa.int32()), pa.array([k] * heap.num_rows, pa.int32()))
                yield from heap.combine_chunks().to_batches()

    return run


def tops(df: DataFrame, wanted: list[Top]) -> DataFrame:
    """The rows of all ``wanted``, with _rank, the number of the order that has them; a row that
    several orders have comes once for each.  Ties beyond the given order are cut at will."""
    made: dict[str, tuple[str, Column]] = {}

    def named(c: Column) -> str:
        return made.setdefault(str(c._jc.node()), (f"_x{len(made)}", c))[0]

    numbers = (T.DoubleType, T.FloatType)
    plans = []
    for top in wanted:
        keys = []
        for c, falling in top.order:
            kind = df.select(c).schema[0].dataType
            if falling and isinstance(kind, numbers):
                # NaN is the largest number, and comes first in a falling order.
                keys.append((named((~F.isnan(c)).cast("int")), "ascending"))
                c, falling = F.when(~F.isnan(c), -c).otherwise(F.lit(0.0)), False
            keys.append((named(c), "descending" if falling else "ascending"))
        plans.append((top.rows, None if top.where is None else named(top.where), keys))
    rows = df.select("*", *[c.alias(n) for n, c in made.values()])
    schema = T.StructType([*rows.schema.fields, T.StructField("_rank", T.IntegerType())])
    found = rows.mapInArrow(_heaps(plans, False), schema)
    return found.repartition("_rank").mapInArrow(_heaps(plans, True), schema).drop(*[n for n, _ in made.values()])
