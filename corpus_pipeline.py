"""A corpus pipeline in five stages.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before it kept and returns
a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lustra.llm import language_id, mixing, ngram_join, packing, scratch, suffix_dedup

#: The stages can't be said in SQL; tests compare them with brute force.
ORACLE_SQL = None
#: From this score on a prediction overrules the document's own language.
SURE = 0.6


def _packed(docs: DataFrame) -> Column:
    """All columns in one, so that none can clash with a stage's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null texts and texts without a letter.  Documents that
    have no language, or another one than a prediction with a score of ``SURE`` or more, get the
    predicted one; the others keep theirs.

    Null ids and sources stay as they are; repeated rows are judged alike and all stay; of equally
    good languages the model takes the first by name; an empty table, or one without any language to
    learn from, gives no row; columns of any name pass through."""
    model = language_id.train(docs)
    known = language_id.identify(docs.select(_packed(docs), "text"), model, keep=["_row"]).filter("lang_pred <> 'und'")
    keeps = F.col("_row.lang").isNotNull() & (F.col("score") < SURE)
    lang = F.when(keeps, F.col("_row.lang")).otherwise(F.col("lang_pred"))
    return known.select(*[(lang if c == "lang" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents keep the one of least id, then of least text hash, then
    the first by its other columns' JSON: the same row in every run, however rows are dealt.

    A null id comes before all others; documents without words (null texts too) are linked with
    nothing and stay; of rows repeated in full one stays; an empty table stays empty; columns of any
    name pass through."""
    linked = ngram_join.linked_components(docs)
    wordless = F.col("n_shingles") == 0
    chosen = linked.groupBy("_comp", F.when(wordless, F.struct("doc_id", "_h")).alias("own")).agg(F.min(F.struct("doc_id", "_h")).alias("keep"))
    chosen = scratch.written(chosen.select(F.col("keep.doc_id").alias("_id"), F.col("keep._h").alias("_hash"), F.col("own").isNotNull().alias("_own")).distinct(), "keep")
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]), {"ignoreNullFields": "false"})
    hashed = docs.select(_packed(docs), F.unhex(F.md5(F.col("text").cast("binary"))).alias("_h"), others.alias("_others"))
    kept = hashed.join(chosen, F.col("_row.doc_id").eqNullSafe(F.col("_id")) & F.col("_h").eqNullSafe(F.col("_hash")))
    # Equal ids and hashes are equal texts: the other columns tell the rows apart.
    kept = kept.groupBy("_id", "_h", F.when(F.col("_own"), F.col("_others")).alias("_whole")).agg(F.min_by("_row", "_others").alias("_row"))
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove every byte of passages of 200 bytes or more that start in more than one place.  All
    documents stay; characters cut in two are dropped with the passage.

    Null texts stay null; null and repeated ids are allowed, and repeated rows lose what they share;
    no place is preferred, so there are no ties; an empty table stays empty; columns of any name pass
    through, and n_chars is counted anew."""
    rest = suffix_dedup.deduplicated(docs)
    return rest.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target asks for.

    Null sources are one source, the last; null texts have size 0, and a source of such texts only is
    left out; rows with equal id and text share their fate, so repeated rows are taken alike; sources
    of equal targets don't depend on each other; an empty table stays empty; columns of any name
    pass through."""
    return mixing.mixed_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 1024.

    A null or empty text is the end id alone; null ids are kept; repeated rows are packed one by one,
    and pieces of equal length take their places by id, piece and ids, rows equal in all of these in
    any order; an empty table gives no piece; other columns are dropped, whatever their names."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("suffix_array_dedup", repeated_passage_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result but the last is written and read again.  A stage's own
    tables are deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{scratch.folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        with scratch.passing(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            scratch.remove(spark, f"{base}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
