"""Pinned sources, rows' places, one-pass loads and the diff index."""

import os
import re
import time

import pytest
from lustra.model import CleaningPlan, Expression
from lustra.operators import rowdiff
from lustra.pipeline import Engine
from lustra.plans.diffindex import DiffIndex
from lustra.plans.materialize import Cache
from lustra.sources import snapshot as snapshots
from lustra.sources.tables import Source
from pyspark.sql import functions as F


def scans(spark, job):
    """Names of the file scans in the executed plans of all queries that ``job`` runs."""
    store = spark._jsparkSession.sharedState().statusStore()
    seen = lambda: {e.executionId(): e.physicalPlanDescription() for e in _list(store.executionsList())}
    before = set(seen())
    out = job()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    found = []
    for k, text in seen().items():
        if k not in before:
            found += re.findall(r"^\(\d+\) Scan (\w+)", text, re.M)
    return found, out


def _list(seq):
    return [seq.apply(k) for k in range(seq.size())]


def plan_of(table, columns, key="k"):
    return CleaningPlan(table, [Expression(c, [c], [f"`{c}`" if c == key else f"upper(`{c}`)"]) for c in columns])


def test_later_files_dont_count(spark, tmp_path):
    at = str(tmp_path / "src/t.parquet")
    spark.range(70).selectExpr("id AS k", "concat('a', id) AS s").repartition(3).write.parquet(at)
    engine, source = Engine(spark, str(tmp_path / "work")), Source(str(tmp_path / "src"))
    project = engine.analyze_project(source, "p")
    spark.range(1000).selectExpr("id + 70 AS k", "'later' AS s").write.mode("append").parquet(at)
    assert source.read(spark, "t").count() == 1070
    assert engine.approve(project) == {"t": "cold_start_done"}
    got = Cache(spark, f"{engine.folder}/cache/p").read("t")
    assert got.columns == ["k", "s"] and sorted(r["k"] for r in got.collect()) == list(range(70))
    assert engine.diff(project, "t").total_changed == 0
    # A new analysis sees them, and the loaded version keeps its own rows until then.
    engine.analyze_project(source, "p")
    engine.state.put("tables", ("p", "t"), status="cold_start_done")
    assert engine.diff(project, "t").total_changed == 0
    assert engine.approve(project) == {"t": "cold_start_done"} and Cache(spark, f"{engine.folder}/cache/p").read("t").count() == 1070
    assert len(os.listdir(tmp_path / "work/snapshots/p/t")) == 1


def test_changed_and_vanished_files(spark, tmp_path):
    at = tmp_path / "src/t.parquet"
    spark.range(50).selectExpr("id AS k", "'x' AS s").repartition(2).write.parquet(str(at))
    engine, source = Engine(spark, str(tmp_path / "work")), Source(str(tmp_path / "src"), primary_keys=(("t", "k"),))
    project = engine.analyze_project(source, "p")
    part = next(p for p in at.iterdir() if p.suffix == ".parquet")
    data = part.read_bytes()
    part.unlink()
    assert engine.approve(project) == {"t": "failed"} and "gone" in engine.table_detail(project, "t")["error"]
    time.sleep(0.01)
    part.write_bytes(data)  # the same bytes at another time may be other rows
    engine.state.put("tables", ("p", "t"), status="analyzed")
    assert engine.approve(project) == {"t": "failed"} and "changed" in engine.table_detail(project, "t")["error"]


def test_sources_without_places_are_copied(spark, tmp_path):
    folder = tmp_path / "src"
    folder.mkdir()
    (folder / "c.csv").write_text("k,s\n1,a\n2,b\n2,b\n")
    keyless = snapshots.take(spark, Source(str(folder), "csv"), "c", str(tmp_path / "s1"))
    (folder / "c.csv").write_text("k,s\n9,z\n")
    rows = keyless.numbered(spark, "n").orderBy("n").collect()
    assert [(r["k"], r["n"]) for r in rows] == [("1", 0), ("2", 1), ("2", 2)]
    keyed = snapshots.take(spark, Source(str(folder), "csv", (("c", "k"),)), "c", str(tmp_path / "s2"))
    assert keyed.rows is None and keyed.read(spark).collect()[0]["s"] == "z"
    with pytest.raises(ValueError):
        keyed.numbered(spark, "n")
    (folder / "c.csv").write_text("k,s\n1,longer\n")
    with pytest.raises(snapshots.SourceChanged):
        keyed.read(spark)


def test_places(spark, tmp_path):
    df = spark.range(5000).selectExpr("id % 7 AS part", "id % 5 AS x", "id AS v")
    df.repartition(4).write.partitionBy("part").option("maxRecordsPerFile", 100).parquet(str(tmp_path / "src/a [b] {c}*.parquet"))
    spark.createDataFrame([], "v long").write.parquet(str(tmp_path / "src/none.parquet"))
    source = Source(str(tmp_path / "src"))
    shot = snapshots.take(spark, Source(str(tmp_path / "src").replace("src", "src")), "none", str(tmp_path / "s0"))
    assert shot.rows == 0 and shot.numbered(spark, "n").columns == ["v", "n"] and shot.numbered(spark, "n").count() == 0
    os.rename(tmp_path / "src/a [b] {c}*.parquet", tmp_path / "src/plain.parquet")
    shot = snapshots.take(spark, source, "plain", str(tmp_path / "s"))
    assert shot.rows == 5000
    first = {tuple(r) for r in shot.numbered(spark, "n").collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        again = shot.numbered(spark, "n")
        assert {tuple(r) for r in again.collect()} == first and sorted(r[3] for r in first) == list(range(5000))
        assert again.columns == [*source.read(spark, "plain").columns, "n"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_keyless_diff_looks_at_the_cache(spark, tmp_path):
    rows = [(k // 2, f"v{k // 2}") for k in range(40)]
    spark.createDataFrame(rows, "_row int, s string").repartition(3).write.parquet(str(tmp_path / "src/t.parquet"))
    engine, project = Engine(spark, str(tmp_path / "work")), "p"
    engine.state.put("projects", (project,), status="completed", source={"location": str(tmp_path / "src"), "format": "parquet", "primary_keys": [], "options": []})
    engine.state.write_memory(project, "Business_Logic", "cleaning_script_t", plan_of("t", ["_row", "s"], "_row").to_json())
    engine.state.put("sync", (project, "t"), status="in_progress")
    assert engine.resume() == ["t"]
    live = engine._cache(project).pointer("t")
    assert live["row"] == "_row1" and engine._cache(project).read("t").columns == ["_row", "s"]
    ruined = spark.read.parquet(live["path"]).withColumn("s", F.when(F.col("_row1") == 5, F.lit("ruined")).otherwise(F.col("s")))
    ruined.cache().count()
    rows = ruined.collect()
    schema = ruined.schema
    ruined.unpersist()
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(live["path"])
    spark.catalog.refreshByPath(live["path"])
    page = engine.diff(project, "t")
    assert page.total_changed == 40 and sorted(r["after__s"] for r in page.rows).count("ruined") == 1
    assert [r["_key"] for r in page.rows] == list(range(40))
    assert page.types == {"_row": ("int", "int"), "s": ("string", "string")} and "before___row1" not in page.rows[0]


def test_load_is_one_pass(spark, tmp_path):
    df = spark.range(3000).selectExpr("id AS k", "CASE WHEN id % 3 = 0 THEN NULL ELSE concat(id % 10, 'x') END AS s")
    df.repartition(3).write.parquet(str(tmp_path / "t.parquet"))
    plan = CleaningPlan("t", [Expression("k", ["k"], ["`k`"]), Expression("s", ["s", "digit"], ["nullif(`s`, '1x')", "try_cast(substr(`s`, 1, 1) as int)"])])
    cache, source = Cache(spark, str(tmp_path / "cache")), spark.read.parquet(str(tmp_path / "t.parquet"))
    found, report = scans(spark, lambda: cache.load(plan, source))
    assert found == ["parquet"]
    assert (report.source_rows, report.cache_rows) == (3000, 3000)
    assert report.nulls == {"k": (0, 0), "s": (1000, 1200), "digit": (None, 1000)}
    empty = cache.load(plan, source.filter("false"))
    assert (empty.source_rows, empty.cache_rows, empty.nulls["s"]) == (0, 0, (0, 0)) and cache.read("t").dtypes == [("k", "bigint"), ("s", "string"), ("digit", "int")]


def test_versions(spark, tmp_path):
    cache, plan = Cache(spark, str(tmp_path)), plan_of("t", ["k"])
    df = spark.range(3).withColumnRenamed("id", "k")
    assert cache._claim("t") == 1 and cache._claim("t") == 2  # two loads at one time
    for _ in range(4):
        cache.load(plan, df)
    names = [n for n in cache.files.names(f"{cache.root}/t") if n.startswith("v=")]
    assert sorted(int(n[2:].split("-")[0]) for n in names) == [3, 4, 5, 6]
    assert len(cache.prune("t")) == 2 and cache.pointer("t")["version"] == 6 and cache.read("t").count() == 3
    assert sorted(int(n[2:].split("-")[0]) for n in cache.files.names(f"{cache.root}/t") if n.startswith("v=")) == [5, 6]
    assert len(cache.prune("t", 1)) == 1 and cache.prune("none") == [] and cache.read("t").count() == 3


def leaf_metrics(df):
    """Files and bytes that the scan of an executed query read."""
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return scan.metrics().apply("numFiles").value(), scan.metrics().apply("filesSize").value()


def test_pages_read_alike(spark, tmp_path):
    n = 60_000
    before = spark.range(n).selectExpr("id * 7 % 60000 AS k", "concat('value ', id) AS s")
    after = before.selectExpr("k", "CASE WHEN k % 4 = 0 THEN s ELSE upper(s) END AS s")
    changed = rowdiff.changed_rows(before, after, "k")
    index = DiffIndex(spark, str(tmp_path / "d"))
    assert not index.load()
    index.build(changed, rows=2000)
    again = DiffIndex(spark, str(tmp_path / "d"))
    assert again.load() and again.total == n * 3 // 4
    keys = [k for k in range(n) if k % 4]
    for page, size in ((1, 50), (900, 50), (40, 50), (41, 50), (7, 3000), (1, 45_000), (450, 100), (451, 100), (10**6, 50), (1, 1)):
        assert [r["_key"] for r in again.page(page, size)] == keys[(page - 1) * size : page * size]
    found, rows = scans(spark, lambda: again.page(900, 50))
    assert len(rows) == 50 and len(found) == 1
    (files, first), (more, deep) = leaf_metrics(again.slice(0, 50)), leaf_metrics(again.slice(44_000, 50))
    assert files == more == 1 and 0.5 < first / deep < 2
    assert again.rows().count() == again.total
    none = DiffIndex(spark, str(tmp_path / "e"))
    none.build(changed.filter("false"))
    assert none.total == 0 and none.page(1, 50) == [] and none.rows().count() == 0
