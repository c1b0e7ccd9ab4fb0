"""Planning, guarding, previewing and loading."""

import hashlib

import pytest
from lustra.config import Settings
from lustra.functions import templates as tpl
from lustra.model import CleaningPlan, ColumnClass, ColumnProfile, Expression, Member, TableProfile
from lustra.operators import capture, classify, consistency, profile, rowdiff, sample
from lustra.pipeline import Engine, NotReady
from lustra.plans import answers, dryrun, guard
from lustra.plans import compile as compiling
from lustra.plans.materialize import Cache
from lustra.plans.state import State
from lustra.sources.tables import Source, TableNotFound
from lustra.streaming import incremental


def value(spark, sql, text):
    return spark.createDataFrame([(text,)], "v string").selectExpr(f"{sql} AS out").first()["out"]


@pytest.mark.parametrize(
    "text,expected", [(" $1,234.50", 1234.5), ("($50.00)", -50.0), ("FREE", 0.0), ("n/a", None), ("1.5K", 1500.0), ("2M", 2e6), ("-$50.00", -50.0), ("", None), (None, None)]
)
def test_currency(spark, text, expected):
    assert value(spark, tpl.currency("v", tpl.Flags(magnitude=True, parentheses=True)), text) == expected


@pytest.mark.parametrize("text,expected", [("1.234,56 €", 1234.56), ("€ 12,5", 12.5)])
def test_european(spark, text, expected):
    assert value(spark, tpl.currency("v", tpl.Flags(european=True)), text) == expected


@pytest.mark.parametrize("text,expected", [("2%", 0.02), ("45", 0.45), ("0.01", 0.01), ("-", None)])
def test_percentage(spark, text, expected):
    assert value(spark, tpl.percentage("v"), text) == pytest.approx(expected)


@pytest.mark.parametrize(
    "text,expected",
    [("2023-01-15", "2023-01-15 00:00:00"), ("25/12/2023", "2023-12-25 00:00:00"), ("Jan 15 2023", "2023-01-15 00:00:00"), ("April 20 2023", "2023-04-20 00:00:00"), ("1577836800", "2020-01-01 00:00:00"), ("Jan 5, 2021", "2021-01-05 00:00:00"), ("soon", None), ("2023", "1970-01-01 00:33:43")],
)
def test_date(spark, text, expected):
    got = value(spark, tpl.date("v", "%d/%m/%Y", more=True), text)
    assert (got and str(got)) == expected


@pytest.mark.parametrize("text,numeric,expected", [("00045", True, "45"), ("000", True, "0"), (" EMP01 ", False, "EMP01"), ("0", True, "0")])
def test_identifier(spark, text, numeric, expected):
    assert value(spark, tpl.identifier("v", numeric), text) == expected


@pytest.fixture(scope="module")
def sales(spark):
    rows = [
        (i, f"${1000 + i:,}.50" if i % 7 else "N/A", f"{i % 30}%" if i % 5 else "N/A", f"{(i * 13) % 100000:,}" if i % 6 else "-", "2021-01-05" if i % 2 else "Jan 5, 2021", "North" if i % 9 else " none ", f"u{i}@x.org")
        for i in range(1, 301)
    ]
    return spark.createDataFrame(rows, "id int, amount string, discount string, price_str string, order_date string, region string, customer_email string")


def analysed(df, table="sales", key="id"):
    t = profile.full_table(df, table, key)
    rows = sample.stratified(df, t)
    return profile.enrich(t, rows), rows


def test_issues_and_classes(sales):
    t, rows = analysed(sales)
    assert rows.count() <= 1000
    assert {"currency_string", "null_variant"} <= set(t.column("amount").issues)
    assert "percentage_string" in t.column("discount").issues
    assert "numeric_as_string" in t.column("price_str").issues
    assert "mixed_date_format" in t.column("order_date").issues
    assert t.column("customer_email").sample_values == [] and t.column("customer_email").issues == []
    kinds = {c.column.name: c.kind for c in classify.classify(t)}
    assert kinds["id"] is ColumnClass.IDENTIFIER and kinds["customer_email"] is ColumnClass.PII
    assert kinds["amount"] is ColumnClass.CLEAN_DET and kinds["order_date"] is ColumnClass.CLEAN_AMBIG
    assert TableProfile.from_json(t.to_json()) == t


def test_plan_dry_run_and_load(spark, sales, tmp_path):
    t, rows = analysed(sales)
    plan = compiling.compile_plan("sales", rows, classify.classify(t))
    sql = compiling.assemble(plan)
    assert guard.validate(spark, sql, "sales") == sql
    diff = dryrun.dry_run(plan, rows)
    assert diff.safe, diff.warnings
    clean = compiling.apply(plan, sales)
    assert dict(clean.dtypes)["amount"] == "double" and dict(clean.dtypes)["order_date"] == "timestamp_ntz"
    assert clean.filter("order_date is null").count() == 0
    cache = Cache(spark, str(tmp_path))
    for version in (1, 2):
        report = cache.load(plan, sales, diff)
        assert report.cache_rows == 300 and not report.warnings
        assert cache.pointer("sales")["version"] == version
    page = rowdiff.diff_page(sales, cache.read("sales"), "id", page=0, page_size=10)
    assert page.total_changed == 300 and len(page.rows) == 10 and page.page == 1
    assert CleaningPlan.from_json(plan.to_json()) == plan


def test_parity_mode_leaves_text(sales):
    t, rows = analysed(sales)
    plan = compiling.compile_plan("sales", rows, classify.classify(t), settings=Settings(mode="parity"))
    assert next(e for e in plan.expressions if e.column == "region").source == "passthrough"


@pytest.mark.parametrize(
    "sql", ["", "DROP TABLE t", "SELECT 1 FROM t; SELECT 2 FROM t", "SELECT a FROM t UNION SELECT a FROM t", "SELECT a FRM t", "SELECT a FROM u", "SELECT * FROM csv.`/etc/passwd`", "WITH x AS (SELECT 1) SELECT * FROM x", "SELECT java_method('a','b') FROM t", "SELECT a FROM db.t"]
)
def test_guard_rejects(spark, sql):
    with pytest.raises(guard.InvalidSql):
        guard.validate(spark, sql, "t")


def test_dry_run_warns(spark, sales):
    plan = CleaningPlan("sales", [Expression("id", ["id"], ["`id`"]), Expression("amount", ["amount"], ["cast(null as double)"])])
    diff = dryrun.dry_run(plan, sales)
    assert not diff.safe and any("missing" in w for w in diff.warnings) and any("amount" in w for w in diff.warnings)
    assert not dryrun.dry_run(CleaningPlan("sales", [Expression("id", ["id"], ["nope("])]), sales).safe
    assert not dryrun.compare("sales", sales, sales.limit(5)).safe


def test_capture_and_patch(spark):
    df = spark.createDataFrame([(f"{k} hours",) for k in range(15)] + [("n/a",), ("someone@x.org",), ("3 of 4 hours",)], "duration string")
    c = ColumnProfile("duration", "string", sample_values=["1 hours"])
    found = [classify.Classified(c, ColumnClass.CLEAN_DET)]
    seen = []

    def suggest(request):
        seen.append(request)
        return "try_cast(regexp_extract(`duration`, '[0-9.]+', 0) as double)"

    e = capture.heal(df, found, suggest)[0]
    assert e.source == "suggested" and not any("@" in v for v in seen[0]["values"])
    assert capture.heal(df, found)[0].source == "deterministic_fallback"
    assert capture.heal(df, found, lambda r: "java_method('x','y')")[0].source == "deterministic_fallback"
    with pytest.raises(RuntimeError):
        capture.heal(df, found, settings=Settings(strict=True))
    assert capture.target_type(ColumnProfile("basis_points", "string"), ["x"]) is None
    assert capture.target_type(ColumnProfile("code", "string"), ["0042", "0043"]) is None
    assert capture.target_type(ColumnProfile("code", "string"), ["0042"], Settings(mode="parity")) == "DOUBLE"


@pytest.mark.parametrize(
    "values,read",
    [
        (["72 hours", "1,5 h", "0.35 hrs", "n/a", " 7  Hours "], [72.0, 1.5, 0.35, None, 7.0]),
        (["5 kg", "5 g"], None),
        (["1h 30m", "2h 5m"], None),
        (["1,500 h", "2 h"], None),
        (["1,500,000 h", "12,345,678.5 h"], [1500000.0, 12345678.5]),
        (["(3 d)", "-4 d", "+5.5 d"], [3.0, -4.0, 5.5]),
        (["3-4 h"], None),
        (["'3' h", "'4' h"], [3.0, 4.0]),
    ],
)
def test_patterns_without_a_model(spark, values, read):
    df = spark.createDataFrame([(v,) for v in values * 12], "duration string")
    e = capture.heal(df, [classify.Classified(ColumnProfile("duration", "string", sample_values=values), ColumnClass.CLEAN_DET)])[0]
    if read is None:
        assert e.source == "deterministic_fallback"
    else:
        assert e.source == "deterministic" and (len(values) == 1 or "pattern" in e.note)
        got = {r["duration"]: r["x"] for r in df.selectExpr("duration", f"{e.sql[0]} AS x").distinct().collect()}
        assert got == dict(zip(values, read))
        assert capture.heal(df, [classify.Classified(ColumnProfile("duration", "string", sample_values=values), ColumnClass.CLEAN_DET)], settings=Settings(mode="parity"))[0].source == "deterministic_fallback"


def test_patterns_come_from_all_values(spark):
    rows = [(f"{k} hours",) for k in range(100)] + [("2 of 3 hours",)]
    df = spark.createDataFrame(rows, "duration string")
    c = classify.Classified(ColumnProfile("duration", "string", sample_values=["1 hours"]), ColumnClass.CLEAN_DET)
    assert capture.heal(df, [c])[0].source == "deterministic_fallback"
    many = spark.createDataFrame([(f"{chr(97 + k % 26) * (1 + k // 26)} {k}",) for k in range(200)], "duration string")
    assert capture.lost_patterns(many, {"duration": ("try_cast(duration as double)", "DOUBLE")}) == {"duration": []}


def test_guard_after_analysis(spark):
    schema = spark.createDataFrame([], "a string, b int, `c d` date").schema
    for good in ("SELECT a, upper(a) AS x, `c d` FROM t", "SELECT b + 1 AS b FROM T;", "SELECT year(`c d`) AS y FROM t"):
        assert guard.accepts(spark, good, "t", schema)
    for bad in ("SELECT a FROM t LIMIT 1000", "SELECT DISTINCT a FROM t", "SELECT a FROM t WHERE false", "SELECT max(a) AS a FROM t", "SELECT a FROM t ORDER BY a", "SELECT a FROM t GROUP BY a", "SELECT a FROM t HAVING true"):
        assert not guard.accepts(spark, bad, "t") and not guard.accepts(spark, bad, "t", schema)
    for bad in ("SELECT z FROM t", "SELECT element_at(b, 1) AS x FROM t", "SELECT date_add(b, 1) AS x FROM t", "SELECT to_date(b) + a AS x FROM t"):
        assert not guard.accepts(spark, bad, "t", schema)
    assert guard.accepts(spark, "SELECT a FROM `odd name`", "odd name", schema) and spark.catalog.listTables() == [t for t in spark.catalog.listTables() if t.name != "odd name"]


def test_consistency(spark):
    col = lambda name, form, kind="string": ColumnProfile(name, kind, signature=form)
    tables = {"a": TableProfile("a", 100, [col("customer_id", "numeric", "int")]), "b": TableProfile("b", 10, [col("customer_id", "numeric")]), "c": TableProfile("c", 5, [col("agent_id", "numeric")])}
    groups = consistency.find_groups(tables)
    assert [(g.kind, g.canonical, g.to_patch) for g in groups] == [("id", "numeric", ["a", "b"])]
    e = consistency.patcher(groups, "b")(compiling.passthrough(tables["b"].columns[0]), tables["b"].columns[0])
    assert spark.createDataFrame([("000045",)], "customer_id string").selectExpr(e.sql[0]).first()[0] == "45"
    assert consistency.summary(groups)[0]["label"] == "customer_id"
    assert consistency.majority([Member("a", "x", "p", 5), Member("b", "x", "q", 5)], lambda f: f == "q") == "q"


def test_answers(spark):
    c = ColumnProfile("total", "string", issues=["currency_string"], currency_symbols=["$", "€"], sample_values=["$5"])
    e = answers.apply_answer(c, "split")
    assert e.names == ["total_amount", "total_currency"]
    assert tuple(spark.createDataFrame([("€7.5",)], "total string").selectExpr(*e.sql).first()) == (7.5, "EUR")
    assert answers.apply_answer(c, "assume_same") is None and answers.apply_answer(c, "keep").source == "passthrough"
    d = ColumnProfile("d", "string", sample_values=["04-05-2023"])
    got = spark.createDataFrame([("04-05-2023",)], "d string").selectExpr(answers.apply_answer(d, "day_first").sql[0]).first()[0]
    assert (got.month, got.day) == (5, 4)


def test_lifecycle(spark, sales, tmp_path):
    sales.write.parquet(str(tmp_path / "src/sales.parquet"))
    spark.createDataFrame([(1, "a")], "id int, s string").write.parquet(str(tmp_path / "src/tiny.parquet"))
    source = Source(str(tmp_path / "src"), primary_keys=(("sales", "id"), ("tiny", "id")))
    engine = Engine(spark, str(tmp_path / "work"))
    assert source.list_tables(spark) == ["sales", "tiny"]
    with pytest.raises(TableNotFound):
        source.read(spark, "none")
    project = engine.analyze_project(source, "p")
    assert engine.status(project)["status"] == "ready"
    with pytest.raises(NotReady):
        engine.diff(project, "sales")
    assert engine.approve(project, ["sales"], {"sales": {"order_date": "whatever you like"}}) == {"sales": "failed"}
    assert "fell back" in engine.table_detail(project, "sales")["error"] and engine.state.debug_log(project)[-1]["stage"] == "approval"
    engine.state.put("tables", (project, "sales"), status="analyzed")
    assert engine.approve(project, ["sales"]) == {"sales": "cold_start_done"}
    page = engine.diff(project, "sales")
    assert page.total_changed > 0 and page.rows
    assert engine.approve(project, ["tiny"]) == {"tiny": "cold_start_done"}
    engine.state.put("sync", ("p", "tiny"), status="in_progress")
    assert engine.resume() == ["tiny"]


def test_state(spark, tmp_path):
    s = State(str(tmp_path), spark)
    s.write_memory("p", "d", "t", "one")
    s.write_memory("p", "d", "t", "two")
    assert s.read_memory("p", "d", "t") == "two" and s.read_memory("p", "d", "x") is None


def test_stream_and_merge(spark, tmp_path):
    df = spark.createDataFrame([(1, "$5"), (2, "n/a")], "id int, amount string")
    df.write.parquet(str(tmp_path / "in"))
    plan = CleaningPlan("t", [Expression("id", ["id"], ["`id`"]), Expression("amount", ["amount"], [tpl.currency("`amount`")])])
    incremental.append_only(spark, plan, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, 5.0), (2, None)]
    old = spark.createDataFrame([(1, 1, None), (2, 1, None)], "id int, at int, gone timestamp")
    new = spark.createDataFrame([(1, 2, None)], "id int, at int, gone timestamp").union(spark.sql("SELECT 2, 2, timestamp'2020-01-01'"))
    assert [r["id"] for r in incremental.merged(old, new, "id", "at", "gone").collect()] == [1]
    for kind, no, yes in (("boolean", False, True), ("int", 0, 1), ("string", "no", "Yes")):
        old = spark.createDataFrame([(1, 1, no), (2, 1, no), (3, 1, None), (None, 1, no)], f"id int, at int, is_deleted {kind}")
        new = spark.createDataFrame([(2, 1, yes), (4, 1, no)], old.schema)
        assert sorted(r["id"] or 0 for r in incremental.merged(old, new, "id", "at", "is_deleted").collect()) == [0, 1, 3, 4]


def test_guard_allows_and_denies(spark):
    for bad in ("explode(sequence(1, 9))", "randstr(5)", "current_timestamp()", "current_timestamp", "row_number() over (order by a)", "my_udf(a)", "uuid()"):
        assert not guard.safe_expression(spark, bad)
        with pytest.raises(guard.InvalidSql):
            guard.validate(spark, f"SELECT {bad} AS a FROM t", "t")
    flags = tpl.Flags(magnitude=True, parentheses=True)
    for good in (tpl.currency("`a`", flags), tpl.percentage("`a`"), tpl.date("`a`", "%d/%m/%Y", more=True), tpl.boolean("`a`"), tpl.currency_code("`a`"), tpl.identifier("`a`", True), tpl.currency("`a`", tpl.Flags(european=True))):
        assert guard.safe_expression(spark, good)


@pytest.mark.parametrize("key", ["id", None])
def test_sample_in_one_scan(spark, tmp_path, key):
    rows = [(k, k % 7, float("nan") if k == 77 else float(k % 11), None if k % 5 else "x", f"wide {k}", {"m": k}) for k in range(3000)]
    schema = "id int, a int, b double, c string, d string, e map<string,int>"
    spark.createDataFrame(rows + rows[:50], schema).repartition(5).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    t = profile.full_table(df, "t", key)
    got = sample.stratified(df, t)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in plan.splitlines() if "Relation" in line]) == 1
    found = [r["id"] for r in got.collect()]
    assert len(found) == len(set(found)) <= 1000
    own = {k: hashlib.md5(str(k).encode()).hexdigest() for k in range(3000)}
    if key:
        wanted = set(sorted(own, key=own.get)[:400]) | {*range(20), *range(2980, 3000)} | set(sorted((k for k in own if k % 5), key=own.get)[:10])
        for first in (lambda k: (k % 7, own[k]), lambda k: (-(k % 7), own[k]), lambda k: (k == 77, k % 11, own[k]), lambda k: (k != 77, -(k % 11), own[k])):
            wanted |= set(sorted(own, key=first)[:21])  # rows repeated in full take places of their own
        assert set(found) <= wanted and len(found) > len(wanted) - 60
    assert {0, 2999, 77} <= set(found)
    again = {r["id"] for r in sample.stratified(df.repartition(11), t).collect()}
    assert again == set(found)


def test_tops(spark):
    from lustra.operators.topk import Top, tops
    from pyspark.sql import functions as F

    rows = [(k, f"s{k * 37 % 1000:03}", [None, 1.5, float("nan"), float("inf"), -2.0][k % 5]) for k in range(1000)]
    df = spark.createDataFrame(rows, "k int, s string, d double").repartition(7)
    wanted = [Top(5, ((F.col("s"), True),)), Top(3, ((F.col("d"), True), (F.col("k"), False)), F.col("d").isNotNull()), Top(4, ((F.col("d"), False), (F.col("k"), True)), F.col("d").isNotNull()), Top(9, ((F.col("k"), False),), F.lit(False)), Top(2000, ((F.col("k"), False),), F.col("k") % 2 == 0)]
    got = {}
    for r in tops(df, wanted).collect():
        got.setdefault(r["_rank"], []).append(r["k"])
    assert {k: sorted(v) for k, v in got.items()} == {0: sorted(sorted(range(1000), key=lambda k: rows[k][1])[-5:]), 1: [2, 7, 12], 2: [984, 989, 994, 999], 4: list(range(0, 1000, 2))}
    assert tops(df.filter("false"), wanted).count() == 0


def test_diverse_values(spark):
    values = ["a", "bb", "ccc", "dd", "a-b", "x y", "eee", "f", ""]
    df = spark.createDataFrame([(v, "one") for v in values * 3] + [(None, "one")], "v string, w string")
    own = lambda v: hashlib.md5(v.encode()).hexdigest()
    longest = min((v for v in values if len(v) == 3), key=own)
    rest = sorted((v for v in values if v not in (longest, "")), key=lambda v: (v.isalnum(), own(v)))
    got = sample.diverse_values(df, ["v", "w"], 6)
    assert got == {"v": [longest, "", *rest][:6], "w": ["one"]}
    assert "Window" not in sample.value_ranks(spark.createDataFrame([("n", v, own(v)) for v in values], "name string, value string, pos string"))._jdf.queryExecution().optimizedPlan().toString()


def test_issues_of_rare_values(spark, tmp_path):
    import compare
    import pandas as pd
    from lustra import catalogue

    day = pd.Timestamp("1995-01-02")
    orders = pd.DataFrame({"o_orderkey": range(8000), "o_custkey": 1, "o_totalprice": 10.5, "o_orderdate": day, "o_orderpriority": "5-LOW"})
    last = max(range(0, 8000, 4), key=lambda k: hashlib.md5(str(k).encode()).hexdigest())
    orders.loc[last, "o_orderpriority"] = "\u20ac 5%"
    orders.to_parquet(tmp_path / "orders.parquet", coerce_timestamps="us")
    got = dict(map(tuple, catalogue.queries()["detect_issues"](spark, str(tmp_path)).collect()))
    assert got["priority"] == "currency_string,inconsistent_casing,needs_trim,null_variant,percentage_string"
    con = compare.duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    assert got == dict(con.execute(catalogue.oracle_sql()["detect_issues"]).fetchall())


def test_date_signature_of_all_rows(spark, tmp_path):
    import pandas as pd
    from lustra import catalogue

    # The first thousand keys by hash have no date, all others have one.
    at = lambda k: hashlib.md5(str(k).encode()).hexdigest()
    dateless = sorted((k for k in range(-6000, 0) if -k % 12 > 1), key=at)[:1000]
    dated = [k for k in range(1, 9000) if at(k) > at(dateless[-1])][:2000]
    assert len(dated) == 2000
    pd.DataFrame({"c_custkey": dateless + dated, "c_name": "x", "c_acctbal": 1.0, "c_nationkey": 1, "c_mktsegment": "a"}).to_parquet(tmp_path / "customer.parquet")
    assert [tuple(r) for r in catalogue.queries()["date_signature"](spark, str(tmp_path)).collect()] == [("signup_date", "ambiguous")]
