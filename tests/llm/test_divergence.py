"""The divergence audit against brute force and SQL."""

import collections
import random
import re

import compare
import pytest
from lustra.llm import divergence, queries

SCHEMA = "doc_id long, text string, lang string, source string, base long, term string, _kept int"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, top=50):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = collections.Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in held.items() if n >= least}

        def shares(some):
            n = collections.Counter(t for d in some for t in d[2] if t in kept)
            whole = sum(n.values()) + 5 * len(kept)
            return n, {t: 1 + 10**9 * (n[t] + 5) // whole for t in kept}

        _, q = shares(mine)
        sources = {s: shares([d for d in mine if d[1] == s]) for s in {d[1] for d in mine}}
        for s, (n, p) in sources.items():
            pairs = [(sum(abs(p[t] - other[t]) for t in kept), o) for o, (_, other) in sources.items() if o != s]
            over = [(p[t] - q[t], t) for t in kept if n[t] and p[t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", over, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def rows():
    r = random.Random(3)
    words = ["".join(r.choice("abcÉßZ") for _ in range(r.randint(1, 4))) for _ in range(60)] + ["日本", "日本語", "\x80x", "a'b", "snake_case", "x1y"]
    out = [(None, None, None), ("", "", ""), ("a a a", None, "s"), (" \x00[`{\x7f ", "en", "blank"), (None, "en", "null text"), ("only", "xx", "one"), ("only", "xx", "two"), ("", "xx", "three")]
    for _ in range(600):
        lang, source = r.choice([None, "", "en", "en", "de"]), r.choice([None, "", "s1", "s1", "s1", "s2", "sé", "\U0001f600", "￮"])
        some = words if source == "s1" else words[: r.randint(1, len(words))]
        out.append(("".join(r.choice(some) + r.choice([" ", "  ", "\n", "1", "--"]) for _ in range(r.randint(0, 40))), lang, source))
    return out + [out[30]] * 50 + [("word " * 200_000 + "a", "en", "long")]


def frame(spark, given):
    return spark.createDataFrame([(k, *row, 1, "x", 2) for k, row in enumerate(given)], SCHEMA).repartition(6)


@pytest.mark.parametrize("options", [{}, {"least": 3, "top": 4}, {"least": 1}, {"least": 10_000}])
def test_against_brute_force(spark, options):
    given = rows()
    assert sorted(tuple(r) for r in divergence.source_divergence(frame(spark, given), **options).collect()) == brute(given, **options)


def test_many_blocks_and_small_chunks(spark, monkeypatch):
    given = rows()
    monkeypatch.setattr(divergence, "PAIRS", 7)
    cut = divergence._blocks([("a", 10), ("b", 250), ("c", 30), ("d", 60), ("e", 20)], 100)
    assert cut == [("a", 1, 0, 0), ("b", 3, 0, 0), ("b", 3, 1, 1), ("b", 3, 2, 2), ("c", 1, 0, 3), ("d", 1, 0, 3), ("e", 1, 0, 4)]
    got = divergence.source_divergence(frame(spark, given), least=5, block=60)
    assert sorted(tuple(r) for r in got.collect()) == brute(given, 5)


def test_shares_are_exact(spark):
    from pyspark.sql import functions as F

    r = random.Random(1)
    given = [(n, n + r.randrange(10**13), r.randrange(1, 10**8)) for n in [0, 1, 10**12, *(r.randrange(10**13) for _ in range(200))]]
    df = spark.createDataFrame(given, "a long, b long, c long")
    got = [x[0] for x in df.select(divergence.share(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [1 + 10**9 * (a + 5) // (b + 5 * c) for a, b, c in given]


def test_empty_table(spark):
    assert divergence.source_divergence(frame(spark, [])).count() == 0


@pytest.mark.parametrize("at", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_sql_and_brute_force(spark, at):
    assert compare.difference(spark, compare.connection(at), queries.op12_divergence, queries.OP12_SQL, at) is None
    docs = spark.read.parquet(f"{at}/documents.parquet").select("text", "lang", "source").collect()
    got = sorted(tuple(r) for r in queries.op12_divergence(spark, at).collect())
    assert got == brute([tuple(r) for r in docs]) and got
