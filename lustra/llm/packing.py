"""Packing tokenised documents into sequences: a linear grouping scheme on the length histogram.

Only lengths matter, and there are at most ``capacity`` of them, so the driver plans on counts and
its work doesn't depend on the number of documents.  Large lengths are cut into groups of equal
cardinality and rounded up to their group's largest; configurations of these few sizes are chosen
so as to fill sequences; actual documents take the places of the rounded ones; small documents go
best-fit into what is left.  The plan is a list of runs (length, first rank, count, first sequence,
offset) that rows look up by their rank among the documents of their length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Numbers, cut, ids_after_cuts, token_sizes
from .scratch import ranked, written

#: Most chunks, and most token ids for them, that a worker keeps.
_CHUNKS, _KEPT = 600_000, 4_000_000


class Tokens:
    """Token ids of many texts, by ``tokenizers``.  Texts are cut into chunks where no token can
    cross, and each distinct chunk is encoded once and kept under its own text.  Files whose pre-tokens
    could cross a cut, or whose added tokens hold a space, are encoded as whole texts."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
        added = spec.get("added_tokens", [])
        self.cuts = plain and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        self.sizes = token_sizes(self.tokenizer) if self.cuts else None
        # A chunk after a cut is known without the space before it, a text's first one apart.
        self.first, self.later = Numbers(), Numbers()
        self.at = self.size = self.seen = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype="<u4")

    def _forget(self) -> None:
        """Keep the chunks that were met more than once since the last time, at most half as many as
        there may be; numbers change."""
        often = np.flatnonzero(self.seen > 1)
        if len(often) > _CHUNKS // 2:
            often = np.sort(often[np.argsort(-self.seen[often], kind="stable")[: _CHUNKS // 2]])
        if 2 * int(self.size[often].sum()) > _KEPT:
            often = often[:0]
        number = np.full(len(self.seen), -1, dtype=np.int64)
        number[often] = np.arange(len(often))
        number = number.tolist()
        self.first, self.later = (Numbers({c: number[k] for c, k in known.items() if number[k] >= 0}) for known in (self.first, self.later))
        size, at = self.size[often], self.at[often]
        after = np.cumsum(size)
        self.flat = self.flat[np.repeat(at - (after - size), size) + np.arange(int(size.sum()))]
        self.at, self.size, self.seen = after - size, size, np.zeros(len(often), dtype=np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _numbers(self, known: Numbers, parts: list[str], first: bool) -> np.ndarray:
        out = known.of(parts, len(self.size))
        if known.new:
            self._learn(known.new, first)
        return out

    def _learn(self, new: list[str], first: bool) -> None:
        if first:
            each = self._whole(new)
            ids, size = np.concatenate(each), np.array([len(x) for x in each], dtype=np.int64)
        else:
            ids, size = ids_after_cuts(self.tokenizer, self.sizes, new)
        self.at = np.append(self.at, len(self.flat) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.seen = np.append(self.seen, np.zeros(len(new), dtype=np.int64))
        self.flat = np.concatenate([self.flat, ids.astype("<u4")])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if not self.cuts or not texts:
            return self._whole(texts)
        if len(self.size) > _CHUNKS or len(self.flat) > _KEPT:
            self._forget()
        order, heads, rest, count = cut(texts)
        ends = np.cumsum(count)
        before = self._numbers(self.first, heads, True)
        # Each distinct chunk of these texts is looked up once.
        distinct = rest.dictionary_encode()
        later = self._numbers(self.later, distinct.dictionary.to_numpy(zero_copy_only=False).tolist(), False)[distinct.indices.to_numpy()]
        which = np.insert(later, ends - count, before)
        self.seen += np.bincount(which, minlength=len(self.seen))
        size = self.size[which]
        after = np.cumsum(size)
        ids = self.flat[np.repeat(self.at[which] - (after - size), size) + np.arange(after[-1])]
        out: list = [None] * len(texts)
        for k, x in zip(order.tolist(), np.split(ids, after[ends + np.arange(len(texts))][:-1])):
            out[k] = x
        return out


@lru_cache(1)
def _tokens(path: str) -> Tokens:
    """Kept by a worker over its tasks."""
    return Tokens(path)


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Tokenised documents, cut where they are longer than a sequence; the first piece may be
    shorter.  Rows: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path)

        def rows(keys: list, texts: list[str]) -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], []]
            for key, ids in zip(keys, tokens.ids(texts)):
                data = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                n = len(data) // 4
                at = 0
                piece = 0
                while at < n:
                    stop = at + ((n - at - 1) % capacity + 1)
                    for x, v in zip(out, (key, piece, at, stop - at, zlib.crc32(data[4 * at : 4 * stop]))):
                        x.append(v)
                    at, piece = stop, piece + 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

        for batch in batches:
            keys: list = []
            texts: list[str] = []
            held = 0
            for key, text in zip(batch.column(0), batch.column(1)):
                keys.append(key.as_py())
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held > 1_000_000:
                    yield rows(keys, texts)
                    keys, texts, held = [], [], 0
            if keys:
                yield rows(keys, texts)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _configuration(sizes: list[int], left: list[int], capacity: int) -> dict[int, int]:
    """How many of each size to put into one sequence: the fullest that holds the largest left."""
    lead = next(k for k, n in enumerate(left) if n)
    room = capacity - sizes[lead]
    mask = (1 << (room + 1)) - 1
    reach = [1]
    for k in range(lead, len(sizes)):
        now = reach[-1]
        for _ in range(min(left[k] - (k == lead), room // sizes[k])):
            more = (now | now << sizes[k]) & mask
            if more == now:
                break
            now = more
        reach.append(now)
        if now >> room & 1:
            break
    fill = reach[-1].bit_length() - 1
    chosen = {lead: 1}
    for k in range(len(reach) - 2, -1, -1):
        while not reach[k] >> fill & 1:
            fill -= sizes[lead + k]
            chosen[lead + k] = chosen.get(lead + k, 0) + 1
    return chosen


def plan(counts: dict[int, int], capacity: int = 1024, groups: int = 256, small: float = 1 / 8) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first sequence, offset) that place every document, and the
    number of sequences."""
    placed: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    open_by_gap: dict[int, list[tuple[int, int]]] = {}
    rank = dict.fromkeys(counts, 0)

    large = [(n, counts[n]) for n in sorted(counts, reverse=True) if n > small * capacity and counts[n]]
    per_group = max(1, -(-sum(c for _, c in large) // groups))
    grouped: list[list[list[int]]] = []
    room = 0
    for n, c in large:
        while c:
            if not room:
                grouped.append([])
                room = per_group
            take = min(c, room)
            grouped[-1].append([n, take])
            room -= take
            c -= take
    # Groups that round to the same length are one size.
    sizes: list[int] = []
    stock: list[list[list[int]]] = []
    for g in grouped:
        if sizes and sizes[-1] == g[0][0]:
            stock[-1] += g
        else:
            sizes.append(g[0][0])
            stock.append(g)
    left = [sum(c for _, c in g) for g in stock]

    while any(left):
        chosen = _configuration(sizes, left, capacity)
        times = min(left[k] // a for k, a in chosen.items())
        runs = [(0, times, 0)]  # of sequences: first, count, tokens used
        for k, a in sorted(chosen.items()):
            left[k] -= a * times
            for _ in range(a):
                out = []
                for first, count, used in runs:
                    while count:
                        n, c = stock[k][0]
                        take = min(c, count)
                        placed.append((n, rank[n], take, sequences + first, used))
                        rank[n] += take
                        out.append((first, take, used + n))
                        first += take
                        count -= take
                        stock[k][0][1] -= take
                        if not stock[k][0][1]:
                            stock[k].pop(0)
                runs = out
        for first, count, used in runs:
            if used < capacity:
                open_by_gap.setdefault(capacity - used, []).append((sequences + first, count))
        sequences += times

    for n in sorted((n for n in counts if n <= small * capacity), reverse=True):
        todo = counts[n]
        while todo:
            gap = min((g for g, runs in open_by_gap.items() if g >= n and runs), default=None)
            if gap is None:
                new = -(-todo // (capacity // n))
                open_by_gap[capacity] = [(sequences, new)]
                sequences += new
                gap = capacity
            first, count = open_by_gap[gap].pop()
            take = min(count, todo)
            placed.append((n, rank[n], take, first, capacity - gap))
            rank[n] += take
            todo -= take
            if take < count:
                open_by_gap[gap].append((first + take, count - take))
            if gap > n:
                open_by_gap.setdefault(gap - n, []).append((first, take))
    return placed, sequences


def best_plan(counts: dict[int, int], capacity: int = 1024, groups: int = 256) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The shortest of a few plans that differ in the number of groups and in what counts as small."""
    plans = [plan(counts, capacity, g, s) for g in (groups, capacity) for s in (1 / 4, 1 / 8, 1 / 32)]
    return min(plans, key=lambda x: x[1])


def pack(rows: DataFrame, capacity: int = 1024, groups: int = 256) -> DataFrame:
    """Add sequence_id and offset to rows with doc_id, piece, length (1 to capacity)."""
    spark = rows.sparkSession
    rows = written(rows, "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placed, _ = best_plan(counts, capacity, groups)
    below, firsts = 0, []
    for n in sorted(counts):
        firsts.append((n, below))
        below += counts[n]
    lengths = spark.createDataFrame(firsts, "length long, _below long")
    runs = spark.createDataFrame(placed, "length long, _first long, _count long, _sequence long, offset long")
    runs = runs.join(lengths, "length").select("length", (F.col("_first") + F.col("_below")).alias("_first"), "_count", "_sequence", "offset")
    at = ranked(rows, [F.col("length"), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "lengths", "_rank")
    # At most a few runs for each of `capacity` lengths and configuration, whatever the input's size.
    hit = (at["length"] == runs["length"]) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_count"))
    out = at.join(F.broadcast(runs), hit).drop(runs["length"])
    return out.withColumn("sequence_id", F.col("_sequence") + F.col("_rank") - F.col("_first")).drop("_rank", "_first", "_count", "_sequence")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, groups: int = 256) -> DataFrame:
    """Tokenise, cut and pack; one row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.

    Special tokens in a text get their own ids, as ``tokenizers`` has it.  Defined cases: a null or empty text is the
    end id alone; null ids are kept; repeated rows are packed one by one; an empty table gives no
    piece; other columns are dropped.
    """
    out = pack(pieces(docs, path, id_col, text_col, capacity), capacity, groups)
    return out.select(F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
