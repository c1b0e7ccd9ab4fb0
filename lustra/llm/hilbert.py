"""Sharding along a Hilbert curve, with DataFrame functions only.

Metadata dimensions are quantised to ``bits`` bits, rows are sorted by their index on the curve and
the order is cut into runs, so that each shard covers a compact box of every dimension and readers
can prune shards on any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import ranked, written


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of integer coordinates in [0, 2**bits).

    Works on the axes in place, from the highest bit down (invert or exchange the low bits), then
    Gray-codes and interleaves the bits of all axes.
    """
    n = len(dims)
    axes = [f"a{k}" for k in range(n)]
    start = F.struct(*[d.cast("long").alias(a) for d, a in zip(dims, axes)])

    def undo(state: Column, q: Column) -> Column:
        # One (bit, axis) step; q carries both.
        bit, axis = q["bit"], q["axis"]
        low = bit - 1
        x = [state[a] for a in axes]
        own = F.coalesce(*[F.when(axis == k, x[k]) for k in range(n)])
        inverted = own.bitwiseAND(bit) != 0
        swap = x[0].bitwiseXOR(own).bitwiseAND(low)
        first = F.when(inverted, x[0].bitwiseXOR(low)).otherwise(x[0].bitwiseXOR(swap))
        rest = [F.when((axis == k) & ~inverted, x[k].bitwiseXOR(swap)).otherwise(x[k]) for k in range(1, n)]
        return F.struct(first.alias(axes[0]), *[r.alias(a) for r, a in zip(rest, axes[1:])])

    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("bit"), F.lit(k).alias("axis")) for b in range(bits - 1, 0, -1) for k in range(n)])

    def finish(state: Column) -> Column:
        gray = [state[axes[0]]]
        for a in axes[1:]:
            gray.append(state[a].bitwiseXOR(gray[-1]))
        flip = F.lit(0).cast("long")
        for b in range(bits - 1, 0, -1):
            flip = flip.bitwiseXOR(F.when(gray[-1].bitwiseAND(1 << b) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)).cast("long"))
        out = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for k in range(n):
                bit = F.shiftright(gray[k].bitwiseXOR(flip), b).bitwiseAND(1)
                out = out.bitwiseOR(F.shiftleft(bit, b * n + n - 1 - k))
        return out

    if bits == 1:
        return finish(start)
    return F.aggregate(steps, start, undo, finish)


def hilbert_shards(rows: DataFrame, dims: list[Column], ties: list[Column], shards: int = 16, bits: int = 6) -> DataFrame:
    """Add hilbert, rank (position on the curve), shard (0 to shards - 1) and slot (gapless from 0).

    Shards hold equally many rows, give or take one.  ``dims`` are integers in [0, 2**bits);
    ``ties`` orders rows of one cell and should tell most rows apart.
    """
    rows = rows.withColumn("hilbert", hilbert_index(dims, bits))
    total = rows.count()
    at = ranked(rows, [F.col("hilbert"), *ties], "hilbert")
    shard = F.expr(f"cast((rank * {shards}L) div {max(1, total)}L as int)")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return at.withColumn("shard", shard).withColumn("slot", F.col("rank") - first)


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """Shard documents by size, language and source.

    Law ``rows``: the shards' counts are at most one apart.  Equal texts lie side by side: their
    group takes its least language and source as coordinates, so that a cut parts a group only
    where a shard's border falls into it.

    Returns ``id_col``, size (UTF-8 bytes plus one), text_crc32, law, shard, slot, grown_shard
    (null) and hilbert.  Defined cases: a null text has size 1 and the checksum of no bytes; null
    languages and sources are values of their own; repeated rows get a place each; an empty table
    stays empty; other columns are dropped.
    """
    text = F.col(f"`{text_col}`")
    blank = F.coalesce(text, F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        (F.octet_length(blank) + 1).cast("long").alias("size"),
        F.crc32(blank).alias("text_crc32"),
        F.xxhash64(blank).alias("_text"),
        *[(F.concat(F.lit("="), F.col(c).cast("string")) if c in docs.columns else F.lit(None)).cast("string").alias(f"_{c}") for c in ("lang", "source")],
    )
    groups = written(rows.groupBy("size", "_text").agg(*[F.coalesce(F.min(c), F.lit("")).alias(c) for c in ("_lang", "_source")]), "groups")
    rows = rows.drop("_lang", "_source").join(groups, ["size", "_text"])
    dims = [
        # A text has less than 2**31 bytes.
        F.floor(F.log2("size") * 4).cast("long"),
        F.pmod(F.xxhash64("_lang"), F.lit(128)),
        F.pmod(F.xxhash64("_source"), F.lit(128)),
    ]
    placed = hilbert_shards(rows, dims, [F.col("size"), F.col("_text"), F.col("doc_id"), F.col("text_crc32")], shards, bits=7)
    return placed.select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert"
    )
