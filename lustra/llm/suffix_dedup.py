"""Exact removal of repeated passages, by suffix arrays over candidate contexts.

A string of ``window`` bytes that starts in two places must hold the same minimal seed (the
rightmost least hash of its ``seed``-byte substrings) at the same offset.  So each document is cut
into runs of windows that share their minimal seed; only seeds that occur twice can hold repeats.
Runs with equal bytes repeat in full.  The rest, runs that share a seed but differ near it, are
sorted on both sides of the seed with suffix arrays built by the linear grouping construction
(:mod:`lustra.llm.suffix_array`); neighbouring suffixes give the lengths to which contexts agree,
and a window repeats if another context agrees with it on both sides.  All bytes take part:
candidates are exact, nothing is sampled or capped.

A seed with more than ``hot`` different contexts is too much for one task.  Its runs are cut into
bands of offsets (the last time to single windows), and each band goes to a group of its own, keyed
by the bytes that all windows of the band share.  Equal windows stay in one group, and the narrower
runs are treated as the first ones were: equal ones settled by hash, the rest sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import discard, written
from .suffix_array import suffix_array
from .textkit import BYTE, Rolling, mix, sliding

_LOW = (1 << 24) - 1
_BATCH = 8192


def _runs(data: bytes, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimal seed: seed hash, context hash, first window's start,
    number of windows, seed's offset in the first window."""
    n = len(data)
    if n < window:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    roll = Rolling(BYTE[np.frombuffer(data, dtype=np.uint8)])
    out = []
    block = 1 << 23
    for base in range(0, n - window + 1, block):
        stop = min(n, base + block + window - 1)
        h = mix((roll.prefix[base + seed : stop + 1] - roll.prefix[base : stop + 1 - seed]) * roll.inverse[base : stop + 1 - seed])
        ranked = (h & ~np.uint64(_LOW)) | (np.uint64(_LOW) - np.arange(len(h), dtype=np.uint64))
        least = _LOW - (sliding(ranked, window - seed + 1, np.minimum) & np.uint64(_LOW)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        count = np.diff(np.r_[first, len(least)])
        at = least[first]
        out.append((h[at], first + base, count, at - first))
    g, start, count, offset = (np.concatenate(x) for x in zip(*out))
    context = roll.slices(start, start + count - 1 + window)
    context = mix(context ^ (offset.astype(np.uint64) << np.uint64(32)))
    return g.view(np.int64), context.view(np.int64), start, count, offset


def _once_a_row(row: np.ndarray, g: np.ndarray, c: np.ndarray, loc: np.ndarray) -> tuple:
    """Equal runs of one row as one: row, seed, context and loc of the first, locs of the others."""
    key = c.view(np.uint64) ^ mix(row.astype(np.uint64))
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return row, g, c, loc, pa.nulls(len(row), pa.list_(pa.int64()))
    maybe = twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key
    # Single runs first, then those that may be equal, sorted.
    single, equal = np.flatnonzero(~maybe), np.flatnonzero(maybe)
    order = np.r_[single, equal[np.lexsort((c[equal], g[equal], row[equal]))]]
    row, g, c, loc = row[order], g[order], c[order], loc[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (g[1:] != g[:-1]) | (c[1:] != c[:-1])]
    first = np.flatnonzero(new)
    ends = np.r_[0, np.cumsum(~new)[np.r_[first[1:] - 1, len(new) - 1]]]
    others = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(loc[~new]), mask=pa.array(np.diff(ends) == 0))
    return row[first], g[first], c[first], loc[first], others


def _seeds(window: int, seed: int):
    """The runs of each row.  Runs of equal seed and context in one row, as of a line that it
    repeats, come as one row with the list ``more`` of the other locs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, texts = (batch.column(k) for k in range(3))
            parts, rows = [], []
            for i, data in enumerate(texts):
                got = _runs(data.as_py() or b"", window, seed)
                if len(got[0]):
                    parts.append(got)
                    rows.append((i, len(got[0])))
                if sum(k for _, k in rows) > 200_000 or i == len(texts) - 1:
                    if parts:
                        take = np.repeat([r for r, _ in rows], [k for _, k in rows])
                        g, c, start, count, offset = (np.concatenate(x) for x in zip(*parts))
                        take, g, c, loc, more = _once_a_row(take, g, c, (start << 16) | (count << 8) | offset)
                        take = pa.array(take)
                        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c), ids.take(take), hashes.take(take), pa.array(loc), more], names=["g", "c", "_id", "_h", "loc", "more"])
                    parts, rows = [], []

    return run


def _narrower(data: bytes, loc: int, window: int, seed: int, width: int) -> Iterator[tuple[int, int, int]]:
    """A run cut into bands of ``width`` offsets: group, context and loc of each narrower run."""
    start, count, offset = loc >> 16, (loc >> 8) & 255, loc & 255
    roll = Rolling(BYTE[np.frombuffer(data, dtype=np.uint8, count=count - 1 + window, offset=start)])
    low = offset - count + 1
    band = np.arange(low // width, offset // width + 1)
    first, last = band * width, np.minimum(band * width + width - 1, window - seed)
    least, most = np.maximum(first, low), np.minimum(last, offset)
    tag = lambda x: x.astype(np.uint64) << np.uint64(32)
    group = mix(roll.slices(offset - first, offset - last + window) ^ tag(band))
    context = mix(roll.slices(offset - most, offset - least + window) ^ tag(most))
    narrow = ((start + offset - most) << 16) | ((most - least + 1) << 8) | most
    return zip(group.view(np.int64).tolist(), context.view(np.int64).tolist(), narrow.tolist())


def _contexts(window: int, seed: int, width: int):
    """The bytes left and right of each wanted seed; of hot seeds the narrower runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g", "c", "_id", "_h", "loc", "left", "right"]
        types = [pa.int64()] * 5 + [pa.binary()] * 2
        rows: list[tuple] = []
        held = 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(4))):
                i, h, data, need = (x.as_py() for x in row)
                for x in need:
                    loc = x["loc"]
                    start, count, offset = loc >> 16, (loc >> 8) & 255, loc & 255
                    if x["hot"]:
                        rows += ((g, c, i, h, at, None, None) for g, c, at in _narrower(data, loc, window, seed, width))
                    else:
                        s = start + offset
                        rows.append((x["g"], None, i, h, loc, data[start:s], data[s + seed : start + count - 1 + window]))
                        held += count + window
                    if len(rows) >= 20_000 or held > 8 << 20:
                        yield flush()
                        rows.clear()
                        held = 0
        if rows:
            yield flush()

    return run


def _side(group: np.ndarray, parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort (group, part) by a suffix array.  Returns each row's rank among the distinct ones, and
    for each rank to how many bytes it agrees with the rank before (-1: another group)."""
    half = -(-width // 2)
    raw = np.frombuffer(b"".join(p.ljust(2 * half, b"\0") for p in parts), dtype=np.uint8).reshape(len(parts), 2 * half)
    names, block = np.unique(raw.reshape(-1).view(f"S{half}"), return_inverse=True)
    block = block.reshape(len(parts), 2)
    seen: dict[tuple, int] = {}
    which = np.array([seen.setdefault(k, len(seen)) for k in zip(group.tolist(), block[:, 0].tolist(), block[:, 1].tolist())])
    text: list[int] = []
    for g, a, b in seen:
        text += (len(names) + g, a, b)
    order = np.array([p for p in suffix_array(text) if p % 3 == 0], dtype=np.int64) // 3
    row_of = np.zeros(len(seen), dtype=np.int64)
    row_of[which] = np.arange(len(parts))
    rank = np.zeros(len(seen), dtype=np.int64)
    rank[order] = np.arange(len(order))
    rows = row_of[order]
    differs = raw[rows[1:]] != raw[rows[:-1]]
    agree = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    agree[group[rows[1:]] != group[rows[:-1]]] = -1
    return rank[which], np.r_[-1, agree]


def repeated_windows(group: np.ndarray, left: list[bytes], right: list[bytes], low: np.ndarray, high: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For contexts around a seed, the least and the largest offset (window's start to seed) whose
    window also occurs in another context of the group; -1: none.

    ``left`` is read from the seed outwards.  Offsets ``low``..``high`` are a context's own.
    """
    lrank, lagree = _side(group, [x[::-1] for x in left], reach)
    rrank, ragree = _side(group, right, reach)
    least = np.full(len(left), -1, dtype=np.int64)
    most = np.full(len(left), -1, dtype=np.int64)
    for o in range(int(low.min()), int(high.max()) + 1):
        own = np.flatnonzero((low <= o) & (o <= high))
        if len(own) < 2:
            continue
        lclass = np.cumsum(lagree < o)
        rclass = np.cumsum(ragree < reach - o)
        key = lclass[lrank[own]] * (len(ragree) + 1) + rclass[rrank[own]]
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        hit = np.zeros(len(own), dtype=bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        rows = own[hit]
        least[rows[least[rows] < 0]] = o
        most[rows] = o
    return least, most


def _repeats(window: int, seed: int):
    """Rows ordered by seed; whole groups are gathered into batches."""
    reach = window - seed

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        g, ids, hashes, loc, left, right = zip(*rows)
        loc = np.array(loc, dtype=np.int64)
        group = np.cumsum(np.r_[0, np.diff(np.array(g, dtype=np.int64)) != 0])
        start, count, offset = loc >> 16, (loc >> 8) & 255, loc & 255
        least, most = repeated_windows(group, list(left), list(right), offset - count + 1, offset, reach)
        hit = np.flatnonzero(most >= 0)
        at = start + offset
        return pa.RecordBatch.from_arrays(
            [pa.array([ids[k] for k in hit], pa.int64()), pa.array([hashes[k] for k in hit], pa.int64()), pa.array((at - most)[hit]), pa.array((at - least)[hit] + window)],
            names=["_id", "_h", "start", "end"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns)):
                if len(held) >= _BATCH and row[0] != held[-1][0]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return run


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for i, data, spans in zip(*batch.columns):
                i, data, spans = i.as_py(), data.as_py() or b"", spans.as_py() or []
                kept, at, gone, runs, end = [], 0, 0, 0, -1
                for a, b in sorted((x["start"], x["end"]) for x in spans):
                    if a > end:
                        kept.append(data[at:a])
                        runs += 1
                        gone += b - a
                        end = at = b
                    elif b > end:
                        gone += b - end
                        end = at = b
                kept = b"".join([*kept, data[at:]])
                out.append((i, len(data), gone, runs, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
                held += len(kept) if with_text else 100
                if held > 8 << 20:
                    yield _rows(out)
                    out, held = [], 0
            if out:
                yield _rows(out)

    return run


_CUT = ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]


def _rows(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=_CUT)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> list:
    """Columns that tell rows apart, 128 bits of two hashes of id and text, and the text's bytes."""
    text = F.col(f"`{text_col}`")
    return [F.xxhash64(F.lit(7), F.col(f"`{id_col}`").cast("long"), text).alias("_id"), F.xxhash64(text).alias("_h"), text.cast("binary").alias("_text")]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, seed: int = 50, hot: int = 16384) -> DataFrame:
    """_id, _h and _spans: the byte ranges (start, end) of each row that has repeated windows, in no
    order and overlapping."""
    if not 0 < window - seed < 255 or seed < 8:
        raise ValueError("window - seed must be 1..254 and seed at least 8")
    keyed = docs.select(*_keyed(docs, id_col, text_col))
    seeds = keyed.mapInArrow(_seeds(window, seed), "g long, c long, _id long, _h long, loc long, more array<long>")
    others = F.coalesce("more", F.array().cast("array<long>"))
    number = F.sum(1 + F.size(others)).alias("n")
    shared = written(seeds.groupBy("g").agg(number).filter("n > 1").select("g"), "seeds")
    runs = written(seeds.join(shared, "g"), "runs")
    own = [shared, runs]
    found = []
    start = F.shiftright("loc", 16)
    span = F.shiftright("loc", 8).bitwiseAND(255)
    for width in (16, 1, 0):
        states = written(runs.groupBy("g", "c").agg(number, F.min(F.struct("_id", "_h", "loc")).alias("at")), "contexts")
        hot_seed = F.lit(width > 0) & (F.col("m") > hot)
        mixed = written(states.groupBy("g").agg(F.count("*").alias("m"), F.min("n").alias("least")).filter("m > 1 and least = 1").select("g", hot_seed.alias("hot")), "mixed")
        equal = runs.join(states.filter("n > 1").select("g", "c"), ["g", "c"])
        each = equal.select("_id", "_h", F.explode(F.concat(F.array("loc"), others)).alias("loc"))
        found.append(each.select("_id", "_h", start.alias("start"), (start + span - 1 + window).alias("end")))

        need = states.join(mixed, "g").groupBy("at._id", "at._h").agg(F.collect_list(F.struct("g", "at.loc", "hot")).alias("_need"))
        texts = keyed.join(need, ["_id", "_h"]).select("_id", "_h", "_text", "_need")
        context = written(texts.mapInArrow(_contexts(window, seed, width), "g long, c long, _id long, _h long, loc long, left binary, right binary"), "context")
        ordered = context.filter("left is not null").drop("c").repartition("g").sortWithinPartitions("g")
        found.append(ordered.mapInArrow(_repeats(window, seed), "_id long, _h long, start long, end long"))
        own += [states, mixed, context]
        if not mixed.filter("hot").head(1):
            break
        runs = context.filter("left is null").withColumn("more", F.lit(None).cast("array<long>"))
    spans = reduce(DataFrame.unionByName, found)
    result = written(spans.groupBy("_id", "_h").agg(F.collect_list(F.struct("start", "end")).alias("_spans")), "spans")
    discard(*own)
    return result


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, seed: int = 50, hot: int = 16384, with_text: bool = True) -> DataFrame:
    """Remove every byte that lies in a ``window``-byte string starting in more than one place.

    Returns one row per input row: ``id_col``, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 and kept (the remaining bytes; null unless ``with_text``).

    Defined cases: a null or empty text has no bytes and keeps none; a text shorter than the window
    is kept whole; repeated rows are copies of each other and lose all their windows; null and
    repeated ids are allowed, as rows are told apart by id and text; an empty table gives an empty
    result; other columns are ignored.
    """
    spans = repeated_spans(docs, id_col, text_col, window, seed, hot)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_own"), *_keyed(docs, id_col, text_col))
    cut = rows.join(spans, ["_id", "_h"], "left").select("_own", "_text", "_spans")
    out = cut.mapInArrow(_cut(with_text), "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("_id", id_col)


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            texts = []
            for data, spans in zip(part.column(part.num_columns - 2), part.column(part.num_columns - 1)):
                data, spans = data.as_py(), spans.as_py()
                if data is not None and spans:
                    kept, end = [], 0
                    for a, b in sorted((x["start"], x["end"]) for x in spans):
                        kept.append(data[end : max(a, end)])
                        end = max(end, b)
                    data = b"".join([*kept, data[end:]])
                texts.append(None if data is None else data.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(texts, pa.string())], names=[*part.schema.names[:-2], "_kept"])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the repeated bytes of each text removed, and the pieces of characters that a
    cut leaves over; nulls stay null.  Cases as in :func:`suffix_dedup`."""
    spans = repeated_spans(docs, id_col, text_col, **options)
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("_rest")
    cut = docs.select(rest, *_keyed(docs, id_col, text_col)).join(spans, ["_id", "_h"], "left").select("_rest", "_text", "_spans")
    out = cut.mapInArrow(_cut_texts, T.StructType([cut.schema["_rest"], T.StructField("_kept", T.StringType())]))
    return out.select(*[(F.col("_kept") if c == text_col else F.col(f"_rest.`{c}`")).alias(c) for c in docs.columns])
