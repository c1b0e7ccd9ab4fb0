"""Databases behind JDBC, with the Derby that comes with Spark."""

import datetime

import pytest
from lustra.pipeline import Engine
from lustra.sources import database
from lustra.sources.tables import Source
from pyspark.sql import functions as F

URL = "jdbc:derby:memory:lustra;create=true"


@pytest.fixture(scope="module")
def derby(spark):
    with database._connection(spark, URL, {}) as c:
        s = c.createStatement()
        for sql in (
            "CREATE SCHEMA A1",
            "CREATE SCHEMA A_",
            'CREATE TABLE A1.T (ID BIGINT NOT NULL PRIMARY KEY, "mixed Name" VARCHAR(20))',
            "CREATE TABLE A_.T (X INT NOT NULL, Y INT NOT NULL, D DATE, PRIMARY KEY (Y, X))",
            "CREATE TABLE A_.T_ (N DOUBLE)",
            "CREATE TABLE A_.TX (N DOUBLE)",
            "CREATE VIEW A1.V AS SELECT ID FROM A1.T",
            "INSERT INTO A1.T VALUES (1, 'a'), (2, NULL)",
        ):
            s.execute(sql)
    return spark


def test_reflection(derby):
    found = {(t.schema, t.name): t for t in database.reflect(derby, URL) if t.schema in ("A1", "A_")}
    assert set(found) == {("A1", "T"), ("A_", "T"), ("A_", "T_"), ("A_", "TX")}
    assert found["A1", "T"].columns == (("ID", "BIGINT", False), ("mixed Name", "VARCHAR", True)) and found["A1", "T"].primary_key == ("ID",)
    assert found["A_", "T"].primary_key == ("Y", "X") and [c[0] for c in found["A_", "T_"].columns] == ["N"] and found["A_", "T_"].primary_key == ()
    assert [t.name for t in database.reflect(derby, URL, schema="A1")] == ["T"]
    source = Source(URL, "jdbc", options=(("schema", "A1"),))
    assert source.list_tables(derby) == ["T"] and source.with_keys(derby).primary_key("T") == "ID"
    assert source.read(derby, "T").columns == ["ID", "mixed Name"] and source.read(derby, "T").count() == 2
    assert Source(URL, "jdbc", options=(("schema", "A_"),)).with_keys(derby).primary_keys == ()


@pytest.mark.parametrize("url", ["jdbc:nosuch:x", "sqlite:///x.db", "jdbc:derby:memory:absent"])
def test_unsupported(derby, url):
    with pytest.raises(database.UnsupportedDatabase) as e:
        database.reflect(derby, url)
    assert url.split(":")[0 if not url.startswith("jdbc") else 1] in str(e.value)


def sizes(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]


def test_balanced_ranges(derby):
    n = 20_000
    skewed = derby.range(n).selectExpr("CASE WHEN id % 50 = 7 THEN NULL ELSE CAST(pow(id / 20000.0, 9) * 1e9 AS bigint) END AS k", "id AS v", "date_add(DATE'2020-01-01', CAST(pow(id / 20000.0, 4) * 3000 AS int)) AS d", "CAST(pow(id / 20000.0, 5) AS double) AS x")
    skewed.write.jdbc(URL, "BIG", "overwrite")
    for key, kind in (("k", int), ("d", datetime.date), ("x", float)):
        df = database.read_in_ranges(derby, URL, "BIG", key, 16)
        assert sorted(r["v"] for r in df.select("v").collect()) == list(range(n))
        got = sizes(df)
        assert 12 <= len(got) <= 40
        one = df.groupBy(key).count().agg(F.max("count")).first()[0]
        assert max(got) <= max(2 * n / 16, one + n / 16)
        assert isinstance(df.filter(F.col(key).isNotNull()).first()[key], kind)
    assert max(sizes(database.read_in_ranges(derby, URL, "BIG", "k", 16))) < 2 * n / 16 + 700
    with pytest.raises(ValueError):
        database.key_ranges(derby.createDataFrame([("a",)], "s string"), "s", "s", 4)
    none = database.key_ranges(derby.createDataFrame([], "k long"), "k", "K", 4)
    assert none == ["K IS NOT NULL", "K IS NULL"]


def test_a_heavy_key_is_a_part_of_its_own(derby):
    df = derby.range(1000).selectExpr("CASE WHEN id < 600 THEN 5 ELSE id END AS k")
    conditions = database.key_ranges(df, "k", "k", 8)
    counts = [df.filter(c).count() for c in conditions]
    assert sum(counts) == 1000 and counts.count(600) == 1 and sorted(counts)[-2] <= 250


def test_engine_over_jdbc(derby, tmp_path):
    derby.range(300).selectExpr("CAST(id AS int) AS ID", "concat('$', id, '.50') AS AMOUNT").write.jdbc(URL, "A1.SALES", "overwrite", {"createTableColumnTypes": "AMOUNT varchar(20)"})
    with database._connection(derby, URL, {}) as c:
        s = c.createStatement()
        s.execute("ALTER TABLE A1.SALES ALTER COLUMN ID NOT NULL")
        s.execute("ALTER TABLE A1.SALES ADD PRIMARY KEY (ID)")
    engine = Engine(derby, str(tmp_path))
    project = engine.analyze_project(Source(URL, "jdbc", options=(("schema", "A1"), ("parts", "4"))), "p")
    with database._connection(derby, URL, {}) as c:
        c.createStatement().execute("DELETE FROM A1.SALES WHERE ID < 100")
    assert engine.approve(project, ["SALES"]) == {"SALES": "cold_start_done"}
    got = engine._cache(project).read("SALES")
    # The copy taken at the analysis is what was checked, and what is loaded.
    assert got.count() == 300 and dict(got.dtypes)["AMOUNT"] == "double"
    assert engine.diff(project, "SALES").total_changed == 300
