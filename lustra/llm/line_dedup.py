"""Lines that many documents share: normalised lines are exploded and hashed, distinct documents are
counted for each hash, lines over the threshold are dropped, and the rest is put together again by
position.

All of it is DataFrame functions.  Only hashes and positions are shuffled by line; texts move once, in
the last join, to meet the list of their dropped positions.  Lines of very many documents are salted.  A document is a row; rows are told apart
by a 128-bit hash of id and text, and rows that are equal in both share their fate.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

#: What is stripped at both ends of a line: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: From this share of all counted lines on a line is spread over so many partitions.
SHARE, SALTS = 1 / 1000, 64


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lowered."""
    return F.translate(F.trim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def _hash(key: Column) -> Column:
    return F.md5(key.cast("binary"))


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _text (null: empty), _row (a name of id and text) and all columns of ``docs`` in _all."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"),
        F.col(f"`{id_col}`").cast("long").alias("_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"),
    )
    named = F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit("|"), F.col("_text"))
    return rows.withColumn("_row", F.unhex(F.md5(named.cast("binary"))))


def shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 40, documents: int = 5) -> DataFrame:
    """_key (hash of a line's key), n (documents that hold it), _last (their largest id) for keys of
    at least ``least`` code points in at least ``documents`` documents.  Each document counts once
    for a key, and counts are added up before they are shuffled, so that a line which a third of all
    documents hold is one row of each task."""
    rows = _prepared(docs, id_col, text_col)
    keys = F.transform(F.split("_text", "\n", -1), lambda x: F.when(F.length(F.trim(x, F.lit(BLANKS))) >= least, _hash(line_key(x))))
    once = rows.select("_id", F.explode(F.array_distinct(F.array_compact(keys))).alias("_key"))
    counted = once.groupBy(F.unhex("_key").alias("_key")).agg(F.count("*").alias("n"), F.max("_id").alias("_last"))
    return counted.filter(F.col("n") >= documents)


def dropped_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 40, documents: int = 5) -> DataFrame:
    """_row and _gone, the ascending 0-based positions of the lines that it loses."""
    rows = _prepared(docs, id_col, text_col)
    lines = rows.select("_row", "_id", F.posexplode(F.split("_text", "\n", -1)).alias("_at", "line"))
    long = lines.filter(F.length(F.trim("line", F.lit(BLANKS))) >= least)
    placed = long.select("_row", "_id", "_at", F.unhex(_hash(line_key(F.col("line")))).alias("_key"))
    shared = written(shared_lines(docs, id_col, text_col, least, documents), "shared")
    # A line of very many documents is dealt to SALTS partitions by row.  At most 1 / SHARE lines can have
    # that share of all counts, whatever the input's size.
    held = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = shared.filter(F.col("n") > held * SHARE).select(F.col("_key").alias("_hot"))
    dealt = placed.join(F.broadcast(hot), F.col("_key") == F.col("_hot"), "left")
    dealt = dealt.withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.hash("_row"), F.lit(SALTS))).otherwise(F.lit(0)))
    every = F.when(F.col("n") > held * SHARE, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    keys = shared.withColumn("_salt", F.explode(every))
    hit = dealt.join(keys, ["_key", "_salt"]).filter(~F.col("_id").eqNullSafe(F.col("_last")))
    return hit.groupBy("_row").agg(F.array_sort(F.collect_set("_at")).alias("_gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 40, documents: int = 5) -> DataFrame:
    """All rows and columns of ``docs``, the text without dropped lines, and _lines, _dropped: lines
    before dropping, and how many went.

    Lines whose key (blanks stripped at both ends, A-Z lowered) has at least ``least`` code points
    and is found in at least ``documents`` documents are dropped, but for those of the largest id that
    holds the key.

    Defined cases: a null text is one empty line and comes back empty; a document is a row, so rows
    with equal ids count apart, and all rows of the largest id keep the line; a null id is smaller
    than any other, and a line that only rows without id hold stays in all of them; rows repeated in
    full come back as often as they came; an empty table stays empty; columns of any name pass
    through (columns named _lines and _dropped are replaced).
    """
    gone = dropped_positions(docs, id_col, text_col, least, documents).withColumnRenamed("_row", "_of")
    rows = _prepared(docs, id_col, text_col)
    rows = rows.join(gone, F.col("_row") == F.col("_of"), "left")
    lines = F.split("_text", "\n", -1)
    gone = F.coalesce(F.col("_gone"), F.array().cast("array<int>"))

    def rest(lines: Column) -> Column:
        # What stays are the runs between dropped positions: one slice for each, so the work is linear.
        ends = F.concat(gone, F.array(F.size(lines)))
        starts = F.concat(F.array(F.lit(-1)), gone)
        runs = F.filter(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda r: r["b"] - r["a"] > 1)
        return F.flatten(F.transform(runs, lambda r: F.slice(lines, r["a"] + 2, r["b"] - r["a"] - 1)))

    # The lines are bound by a lambda, so that they are split once and not once for each run.
    kept = F.transform(F.array(lines), lambda x: F.struct(F.size(x).cast("long").alias("n"), F.array_join(rest(x), "\n").alias("text")))[0]
    done = rows.select("_all", F.size(gone).cast("long").alias("_dropped"), F.when(F.size(gone) > 0, kept).otherwise(F.struct(F.size(lines).cast("long").alias("n"), F.col("_text").alias("text"))).alias("_kept"))
    own = [(F.col("_kept.text") if c == text_col else F.col(f"_all.`{c}`")).alias(c) for c in docs.columns if c not in ("_lines", "_dropped")]
    return done.select(*own, F.col("_kept.n").alias("_lines"), "_dropped")
