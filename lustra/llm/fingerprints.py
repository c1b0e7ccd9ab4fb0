"""Threshold-scaled sketches: of each text, every shingle hash below a fixed fraction of the hash
range.  Sketches of different sizes stay comparable, merge by union and estimate containment and
resemblance.

A short text may have few hashes so low, or none.  So a sketch also has the ``LEAST`` least hashes
of its text, wherever they lie: texts of up to as many shingles are kept whole.  Both parts follow
from the union of two sketches, so merging stays exact: the sketch of two texts' shingles together
is :func:`merge` of their sketches.  Two sketches are compared below the threshold that both cover.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import shingle_set

FRACTION = 8
LEAST = 16
_ALL = np.uint64((1 << 64) - 1)


def _limit(fraction: int) -> np.uint64:
    return np.uint64((1 << 64) // fraction)


def _thinned(h: np.ndarray, fraction: int) -> np.ndarray:
    return h[: max(LEAST, int(np.searchsorted(h, _limit(fraction))))]


def sketch(data: bytes, fraction: int = FRACTION, width: int = 5) -> np.ndarray:
    """Sorted shingle hashes below 2**64 / fraction, and the ``LEAST`` least ones in any case; a text
    without words has none."""
    return _thinned(shingle_set(data, width), fraction)


def encode(s: np.ndarray) -> str:
    return base64.b64encode(s.astype(">u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype=">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, fraction: int = FRACTION) -> np.ndarray:
    """Sketch of both texts' shingles together."""
    return _thinned(np.union1d(a, b), fraction)


def _comparable(a: np.ndarray, b: np.ndarray, fraction: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts of two sketches up to the hash to which both know all of their text's."""
    covered = min(_ALL if len(x) < LEAST else max(_limit(fraction) - np.uint64(1), x[LEAST - 1]) for x in (a, b))
    return tuple(x[: np.searchsorted(x, covered, side="right")] for x in (a, b))


def resemblance(a: np.ndarray, b: np.ndarray, fraction: int = FRACTION) -> float:
    """Estimated Jaccard likeness; 1 for two texts without words, 0 for one.  Exact if both texts
    have fewer than ``LEAST`` shingles."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    a, b = _comparable(a, b, fraction)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def containment(a: np.ndarray, b: np.ndarray, fraction: int = FRACTION) -> float:
    """Estimated share of a's shingles that b has; 1 for an a without words, 0 if none of a's can be
    compared."""
    if not len(a):
        return 1.0
    a, b = _comparable(a, b, fraction)
    return len(np.intersect1d(a, b, assume_unique=True)) / max(1, len(a))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: int = FRACTION) -> DataFrame:
    """``id_col``, fingerprint (base64 of the sorted big-endian hashes) of each row.

    Defined cases: null and empty texts have an empty fingerprint; equal texts have equal ones;
    repeated rows are kept; an empty table stays empty; other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [encode(sketch(t.as_py() or b"", fraction)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["i", "fingerprint"])

    rows = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    kind = rows.schema["i"].dataType.simpleString()
    return rows.mapInArrow(run, f"i {kind}, fingerprint string").withColumnRenamed("i", id_col)


def _neighbours(fraction: int):
    """Rows of whole ranges in order; the row after each range's last is there as a borrowed one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        last = None

        def flush():
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=_PAIRS)

        for batch in batches:
            for part, i, borrowed, text in zip(*(batch.column(k) for k in range(4))):
                part, i, borrowed, text = part.as_py(), i.as_py(), borrowed.as_py(), text.as_py() or ""
                now = (part, i, text, sketch(text.encode("utf-8", "replace"), fraction))
                if last is not None and last[0] == part:
                    n = len(last[2])
                    half = n // 2
                    edited = last[2][: n - half] + text[:half]
                    e = sketch(edited.encode("utf-8", "replace"), fraction)
                    row = (last[1], n, hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), encode(last[3]), encode(e), resemblance(last[3], e, fraction), resemblance(last[3], now[3], fraction), containment(last[3], e, fraction))
                    out.append(row)
                    held += len(row[3]) + len(row[4])
                    if held > 4 << 20 or len(out) >= 5000:
                        yield flush()
                        out.clear()
                        held = 0
                last = None if borrowed else now
        if out:
            yield flush()

    return run


_PAIRS = ["i", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_edited"]


#: Most ranges that ids are cut into; the driver holds one number for each.
MOST_RANGES = 100_000


def _position(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` are at most ``value`` (0 for null), by bisection."""
    if not cuts:
        return F.lit(0).cast("long")
    table = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k).cast("long") for k in range(len(cuts).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0).cast("long"), lambda at, step: F.when(F.coalesce(F.get(table, (at + step - 1).cast("int")) <= value, F.lit(False)), at + step).otherwise(at))


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: int = FRACTION, rows_per_range: int = 2000) -> DataFrame:
    """Fingerprints of each text and of its edited text: the last floor(n_chars / 2) code points
    give way to the first as many of the next document by ascending id (after the last: the first).

    Ids are cut into ranges at approximate quantiles, so that one shuffle brings neighbours
    together; each range also borrows the first row of the range after it.  The driver gets one id
    for each range.

    Defined cases: null texts count as empty; null ids come first; rows of equal ids are ordered by
    a hash of the text, then the text; a single row is its own next; an empty table stays empty.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    rows = rows.select("i", "t", F.xxhash64("t").alias("h"))
    schema = "i long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double"
    spark = docs.sparkSession
    total = rows.count()
    # A task streams its range in order, so a range's length costs time only, not memory.
    ranges = max(1, min(MOST_RANGES, total // rows_per_range))
    cuts: list[int] = []
    if ranges > 1:
        found = rows.agg(F.percentile_approx("i", [k / ranges for k in range(1, ranges)], 10 * ranges).alias("q")).first()["q"]
        cuts = sorted(set(found or []))
    placed = rows.select(_position(F.col("i"), cuts).alias("part"), "i", "t", "h")
    firsts = placed.groupBy("part").agg(F.min(F.struct(F.col("i").isNotNull().alias("has"), "i", "h")).alias("first")).orderBy("part").collect()
    if not firsts:
        return spark.createDataFrame([], schema).withColumnRenamed("i", id_col)
    before = [firsts[-1]["part"], *(r["part"] for r in firsts[:-1])]
    lend = spark.createDataFrame([(r["first"]["i"], r["first"]["h"], b) for r, b in zip(firsts, before)], "li long, lh long, lender long")
    lent = placed.join(F.broadcast(lend), F.col("i").eqNullSafe(F.col("li")) & (F.col("h") == F.col("lh")))
    lent = lent.select(F.col("lender").alias("part"), "i", F.lit(True).alias("borrowed"), "t", "h")
    every = placed.select("part", "i", F.lit(False).alias("borrowed"), "t", "h").unionByName(lent)
    every = every.repartition(ranges, F.col("part")).sortWithinPartitions("part", "borrowed", F.col("i").asc_nulls_first(), "h", "t")
    return every.select("part", "i", "borrowed", "t").mapInArrow(_neighbours(fraction), schema).withColumnRenamed("i", id_col)
