"""Classes, gates, overrides, notes and the cross-table run, through the engine where it decides."""

import pytest
from lustra.model import Classified, CleaningPlan, ColumnClass, ColumnProfile, Expression, TableProfile
from lustra.operators import capture, classify, consistency, profile
from lustra.pipeline import Engine
from lustra.plans import answers
from lustra.plans import compile as compiling
from lustra.sources.tables import Source


def kind(c, **more):
    return classify.classify(TableProfile("t", 100, [c]), **more)[0].kind


def column(name, declared="string", **facts):
    return ColumnProfile(name, declared, **facts)


def test_classes():
    K = ColumnClass
    assert kind(column("customer_email")) is K.PII and kind(column("order_id")) is K.IDENTIFIER
    for declared in ("map<string,int>", "array<int>", "struct<a:int>", "binary", "jsonb"):
        assert kind(column("payload", declared)) is K.STRUCTURAL
    assert kind(column("is_open", "boolean", issues=["null_variant"])) is not K.CLEAN_DET
    assert kind(column("remarks", distinct_count=400, distinct_ratio=0.99)) is K.FREE_TEXT
    assert kind(column("remarks", distinct_count=10, distinct_ratio=0.99)) is not K.FREE_TEXT
    assert kind(column("total", issues=["currency_string"], currency_symbols=["$", "€"])) is K.CLEAN_AMBIG
    assert kind(column("total", issues=["currency_string"])) is K.CLEAN_DET
    # A class from outside may take a column out of cleaning, and never into it.
    assert kind(column("total", issues=["currency_string"]), overrides={"total": K.PII}) is K.PII
    assert kind(column("total", issues=["currency_string"]), overrides={"total": K.OBSERVE}) is K.CLEAN_DET
    assert kind(column("customer_email"), overrides={"customer_email": K.CLEAN_DET}) is K.PII


def test_inconsistent_boolean(spark):
    df = spark.createDataFrame([("yes",), ("no",), (" YES",), (None,)] * 5, "paid string")
    facts = profile.whole_facts(df.filter("paid is null or paid <> ' YES'"), ["paid"])["paid"]
    assert "inconsistent_boolean" in profile.issues_of(facts, "string", facts["exact"])
    facts = profile.whole_facts(df, ["paid"])["paid"]
    assert "inconsistent_boolean" not in profile.issues_of(facts, "string", facts["exact"])  # three spellings


def test_few_values_and_currencies(spark):
    few = spark.createDataFrame([("$1",)] * 9 + [(None,)] * 50, "price string")
    c = column("price", issues=["currency_string"], sample_values=["$1"])
    e = capture.heal(few, [Classified(c, ColumnClass.CLEAN_DET)])[0]
    assert e.source == "passthrough" and "fewer than 10" in e.note
    many = spark.createDataFrame([("$1",), ("€2",)] * 9, "price string")
    c = column("price", issues=["currency_string"], currency_symbols=["$", "€"], sample_values=["$1", "€2"])
    e = capture.heal(many, [Classified(c, ColumnClass.CLEAN_DET)])[0]
    assert e.source == "deterministic" and "$ €" in e.note and "aren't converted" in e.note


def test_audit_names_every_column():
    plan = CleaningPlan("t", [Expression("a", ["a"], ["`a`"]), Expression("b", ["b_amount", "b_currency"], ["1", "2"], "answer", ["currency_string"], "by hand")])
    text = compiling.audit(plan, [Classified(column("a"), ColumnClass.OBSERVE), Classified(column("b"), ColumnClass.CLEAN_AMBIG)])
    lines = text.splitlines()
    assert lines[0].startswith("table t: 2 columns") and lines[1] == "- a [OBSERVE] -> a (passthrough)"
    assert lines[2] == "- b [CLEAN_AMBIG] -> b_amount, b_currency (answer) issues: currency_string note: by hand"


def test_questions_of_expressions():
    e = Expression("d", ["d"], ["`d`"], "suggested", question="Which comes first?", options=["Month first", "Day first"])
    got = answers.asked([e, Expression("x", ["x"], ["`x`"])])
    assert [q["column"] for q in got] == ["d"] and got[0]["default"] == got[0]["options"][0]["id"] and [o["label"] for o in got[0]["options"]] == ["Month first", "Day first"]
    assert answers.source_of([e]) == "suggested" and answers.source_of([Expression("x", ["x"], ["`x`"], "deterministic_fallback")]) == "deterministic_fallback" and answers.source_of([]) == "deterministic"
    assert answers.is_known("day_first") and not answers.is_known("custom") and not answers.is_known("whatever")


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    """Two tables whose keys of one name differ in form, and a third without anything in common."""
    at = tmp_path_factory.mktemp("cross")
    spark.createDataFrame([(k, f"n{k % 3}") for k in range(60)], "customer_id int, kind string").write.parquet(f"{at}/src/customers.parquet")
    spark.createDataFrame([(f"{k % 60:06}", f"${k}.00") for k in range(300)], "customer_id string, amount string").write.parquet(f"{at}/src/sales.parquet")
    spark.createDataFrame([(k, "x") for k in range(30)], "thing_id int, kind string").write.parquet(f"{at}/src/things.parquet")
    asked = []

    def gate(schema):
        asked.append(schema)
        if "thing_id" in schema:
            raise RuntimeError("out of order")
        return {"kind": ("PII", "high"), "amount": ("PII", "low"), "customer_id": ("PII", "high"), "absent": ("PII", "high")}

    engine = Engine(spark, f"{at}/work", gate=gate)
    return engine, engine.analyze_project(Source(f"{at}/src"), "p"), asked


def test_cross_table_run(spark, project):
    engine, name, _ = project
    status = engine.status(name)
    assert status["status"] == "ready" and {t: e["status"] for t, e in status["tables"].items()} == {"customers": "analyzed", "sales": "analyzed", "things": "analyzed"}
    assert [(g["kind"], g["label"]) for g in status["cross_table"]] == [("id", "customer_id")]
    assert "customer_id" in engine.table_detail(name, "sales")["sql"]
    assert engine.approve(name, ["sales", "customers"]) == {"sales": "cold_start_done", "customers": "cold_start_done"}
    sales, customers = (engine._cache(name).read(t) for t in ("sales", "customers"))
    assert {r["customer_id"] for r in sales.select(sales.customer_id.cast("string")).collect()} == {str(k) for k in range(60)}
    assert sales.join(customers, sales.customer_id.cast("string") == customers.customer_id.cast("string")).count() == 300


def test_a_failing_alignment_leaves_the_plan(spark, project, monkeypatch):
    engine, name, _ = project
    for table in ("sales", "customers"):
        engine.state.put("tables", (name, table), status="analyzed")
    before = engine.table_detail(name, "sales")["plan"]
    monkeypatch.setattr(consistency, "patcher", lambda *_: 1 / 0)
    engine._align(name, engine._source(name))
    assert engine.table_detail(name, "sales")["plan"] == before and engine.status(name)["cross_table"]


def test_gate(project):
    """Names and types go out, never values; only sure answers on columns that values would decide count."""
    engine, name, asked = project
    assert {"customer_id": "int", "kind": "string"} in asked and {"customer_id": "string", "amount": "string"} in asked
    assert engine.table_detail(name, "customers")["classes"] == {"IDENTIFIER": 1, "PII": 1}
    assert "PII" not in engine.table_detail(name, "sales")["classes"] and "PII" not in engine.table_detail(name, "things")["classes"]
    before = len(asked)
    t = TableProfile.from_json(engine.table_detail(name, "customers")["profile"])
    assert engine.gate.overrides(name, t) == {"kind": ColumnClass.PII} and len(asked) == before  # kept
