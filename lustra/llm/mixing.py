"""Mixing sources to target weights.

Sizes are added up by source, targets follow from the weights, and a source's repetition rate is
its target over its size.  Each document is taken floor(rate) times, and once more with the
remaining fraction as probability, decided by a hash of the document.  All of it is DataFrame
functions; the driver sees sums only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import ranked, written

WEIGHTS = (5, 2, 1)
LIMIT = 3
#: A table of targets up to this many sources is broadcast; beyond, sources are joined by shuffle.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, source_size, target from rows (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn and share the total.  A target over
    ``limit`` times its source's size stops there, and the excess is shared anew by weight until
    none is above.  Each round is one aggregate; rounds end when no further source stops.
    """
    order = ranked(sizes, [F.col("source").isNull(), F.col("source")], "sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    rows = written(order.select("source", "source_size", weight.alias("weight")), "weights")
    level, stopped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("source_size") * limit < F.col("weight") * F.lit(level)
        got = rows.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.when(full, F.col("source_size") * limit)), F.lit(0)).alias("kept"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("open"),
            F.count_if(full).alias("stopped"),
        ).first()
        if got["stopped"] == stopped or not got["open"]:
            break
        stopped = got["stopped"]
        level = (got["total"] - got["kept"]) / got["open"]
    share = F.lit(0.0) if level is None else F.col("weight") * F.lit(float(level))
    return rows.select("source", "source_size", F.least(F.col("source_size") * F.lit(float(limit)), share).alias("target"))


def mix(docs: DataFrame, size: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: int = 0) -> DataFrame:
    """All rows and columns of ``docs`` with _size, _source_size, _target and _copies.

    Defined cases: a null text has size 0; null sources are one source; a source whose documents
    are all empty has target 0 and is not taken; rows with equal id and text share their fate; an
    empty table stays empty; columns of the same names are replaced.
    """
    size = F.coalesce(word_count(F.col(f"`{text_col}`")), F.lit(0)).cast("long") if size is None else size
    docs = docs.drop("_size", "_source_size", "_target", "_copies", "_source", "_s", "source_size", "target")
    rows = docs.withColumn("_size", size).withColumn("_source", F.col(f"`{source_col}`").cast("string"))
    sizes = rows.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    targets = written(source_targets(sizes, weights, limit), "targets")
    named = targets.withColumnRenamed("source", "_s")
    if targets.count() <= BROADCAST_SOURCES:
        named = F.broadcast(named)
    joined = rows.join(named, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))).cast("binary"))
    chance = F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    whole = F.floor(rate)
    copies = (whole + F.when(chance < rate - whole, F.lit(1)).otherwise(F.lit(0))).cast("long")
    return joined.withColumn("_copies", copies).withColumnRenamed("source_size", "_source_size").withColumnRenamed("target", "_target").drop("_source")


def mixed_rows(docs: DataFrame, size: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row as many times as it is taken, with the columns of ``docs``, whatever
    their names."""
    own = {id_col: "_i", text_col: "_t", source_col: "_o"}
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in own]).alias("_rest")
    given = [] if size is None else [size.alias("_given")]
    packed = docs.select(rest, *[F.col(f"`{c}`").alias(k) for c, k in own.items()], *given)
    rows = mix(packed, None if size is None else F.col("_given"), own[id_col], own[text_col], own[source_col], **options)
    rows = rows.filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return rows.select(*[F.col(own[c] if c in own else f"_rest.`{c}`").alias(c) for c in docs.columns])
