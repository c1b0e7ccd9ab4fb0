"""Profiles that are merged from files."""

import os

import pytest
from lustra.operators import profile, profilestate
from lustra.sources import snapshot as snapshots
from lustra.sources.tables import Source
from pyspark.sql import functions as F

SCHEMA = "k long, s string, d double, m map<string,int>, e string"


def rows(n):
    return [(k, [None, " $5 ", "10%", "n/a", "TRUE", "2021-01-05", f"{k}"][k % 7], float("nan") if k % 50 == 0 else k / 3 if k % 3 else None, {"a": k} if k % 2 else None, None) for k in n]


def summary(state):
    return {r["name"]: r.asDict() for r in profilestate.summary(profilestate.merged(state.read())).collect()}


def test_append_and_rewrite(spark, tmp_path):
    at, source = str(tmp_path / "src/t.parquet"), Source(str(tmp_path / "src"))
    state = profilestate.ProfileState(spark, str(tmp_path / "state"))
    take = lambda n: snapshots.take(spark, source, "t", str(tmp_path / n))
    spark.createDataFrame(rows(range(3000)), SCHEMA).coalesce(1).write.parquet(at)
    assert state.update(take("1")) == profilestate.Update(1, 0, 0)
    first = {f for f in os.listdir(at) if f.endswith(".parquet")}
    spark.createDataFrame(rows(range(3000, 9000)), SCHEMA).coalesce(1).write.mode("append").parquet(at)
    # The known file isn't read: its place is taken by something unreadable while the new one is measured.
    second = take("2")
    old = os.path.join(at, *first)
    os.rename(old, old + ".kept")
    assert state.update(second) == profilestate.Update(1, 1, 0)
    os.rename(old + ".kept", old)
    whole = spark.createDataFrame(rows(range(9000)), SCHEMA)
    got = summary(state)
    facts = profile.whole_facts(whole, ["s"])["s"]
    for c in ("k", "s", "d", "m", "e"):
        nulls = whole.filter(F.col(c).isNull()).count()
        assert (got[c]["rows"], got[c]["nulls"], got[c]["null_pct"]) == (9000, nulls, nulls / 9000)
    assert {r: got["s"][r] for r in profile.RATIOS} == pytest.approx({r: facts[r] for r in profile.RATIOS}, abs=1e-12)
    assert abs(got["s"]["distinct_values"] - facts["exact"]) <= 0.05 * facts["exact"] and got["e"]["distinct_values"] == 0
    assert sorted(profilestate.issues(got["s"])) == sorted(profile.issues_of(facts, "string", facts["exact"]))
    numbers = sorted(r[2] for r in rows(range(9000)) if r[2] is not None and r[2] == r[2])
    for share, q in zip((0.25, 0.5, 0.75), got["d"]["quantiles"]):
        assert abs(sum(x <= q for x in numbers) / len(numbers) - share) < 0.02
    assert got["s"]["quantiles"] is None and got["e"]["quantiles"] is None
    # A rewritten file is measured again, and its old facts go; so do those of a file that is gone.
    spark.createDataFrame(rows(range(10)), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "other"))
    part = next(f for f in os.listdir(tmp_path / "other") if f.endswith(".parquet"))
    os.replace(tmp_path / "other" / part, old)
    os.unlink(os.path.join(at, f".{os.path.basename(old)}.crc"))
    spark.catalog.refreshByPath(at)
    assert state.update(take("3")) == profilestate.Update(1, 1, 1) and summary(state)["k"]["rows"] == 6010
    os.unlink(old)
    assert state.update(take("4")) == profilestate.Update(0, 1, 1) and summary(state)["k"]["rows"] == 6000
    assert len([f for f in os.listdir(tmp_path / "state") if f.startswith("state-")]) == 1


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "src/t.parquet"))
    state = profilestate.ProfileState(spark, str(tmp_path / "state"))
    state.update(snapshots.take(spark, Source(str(tmp_path / "src")), "t", str(tmp_path / "s")))
    assert all(r["rows"] == 0 for r in summary(state).values())
