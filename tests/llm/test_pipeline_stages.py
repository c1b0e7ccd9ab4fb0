"""The pipeline's stages: repeatable choices, and tables that go with their stage."""

import collections
import os
import random

import corpus_pipeline
from lustra.llm import scratch
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row long, _others string"


def test_survivor_is_the_same_in_every_run(spark):
    r = random.Random(4)
    long = " ".join(str(r.randrange(10**6)) for _ in range(60))
    rows = [(i, t, lang, s, n, 1, "x") for i in (None, 5) for t in (long, "", None) for lang in ("en", None) for s in ("p", "q", None) for n in (1, None)]
    seen = set()
    for k in range(4):
        r.shuffle(rows)
        kept = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows + rows[:7], SCHEMA).repartition(1 + 2 * k), "").collect()
        seen.add(tuple(sorted(map(str, kept))))
    assert len(seen) == 1
    # All copies of the long text are one component: one row of it stays, and each wordless row once.
    texts = collections.Counter(x["text"] for x in kept)
    assert texts == {long: 1, "": 24, None: 24} and len(set(map(str, kept))) == len(kept)


def test_tables_go_with_their_stage(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    folder = scratch.folder(spark)
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before}
    assert left <= {"pipeline", "pieces", "lengths"}
    assert out.count() > 0 and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0
