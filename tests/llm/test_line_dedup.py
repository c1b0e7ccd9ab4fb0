"""Line dedup against brute force and SQL."""

import collections
import hashlib
import random

import compare
import pytest
from lustra.llm import line_dedup, queries

SCHEMA = "doc_id long, text string, _row string, line int, _gone string, n long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute(rows, least=40, documents=5):
    held, last = collections.Counter(), {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held[k] += 1
            last[k] = max((x for x in (last.get(k), i) if x is not None), default=None)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= least and held[key(x)] >= documents and last[key(x)] != i)]
        text = "\n".join(stay)
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256(text.encode()).hexdigest(), text))
    return sorted(out, key=repr)


def rows():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeÉzZ") for _ in range(r.randint(1, 9)))
    common = [" ".join(word() for _ in range(12)).ljust(40, "x") for _ in range(12)]
    edge = ["é" * 39, "é" * 40, "Ü" * 41, "\xa0" + "q" * 39, "Ab" * 20]
    out = [(0, None), (1, ""), (2, "\n\n"), (3, " \t\r"), (4, "short\nlines\n")]
    for k in range(5, 60):
        lines = []
        for _ in range(r.randint(0, 30)):
            x = r.choice([*common, *edge, word(), " ".join(word() for _ in range(15))])
            lines.append(r.choice(["", " ", "\t\x0b"]) + (x.upper() if x.isascii() and r.random() < 0.3 else x) + r.choice(["", "\r", " \x0c"]))
        out.append((k, "\n".join(lines)))
    out += [out[30], out[30], (31, "again " + common[0] + "\n" + common[1]), (None, common[2]), (None, common[2] + "\n" + common[3])]
    out += [(None, "only rows without id hold this line, all of them")] * 6
    return out + [(100 + k, "the very same line again and again, nothing besides it") for k in range(40)] + [(1000, "\n".join(common * 3000))]


def test_against_brute_force(spark):
    given = rows()
    docs = spark.createDataFrame([(i, t, "a", 1, "b", 2) for i, t in given], SCHEMA).repartition(5)
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "_lines", "_dropped"]
    found = [(r["doc_id"], r["_lines"], r["_dropped"], hashlib.sha256(r["text"].encode()).hexdigest(), r["text"]) for r in got.collect()]
    assert sorted(found, key=repr) == brute(given)
    assert got.filter("_row = 'a' and line = 1 and _gone = 'b' and n = 2").count() == len(given)
    few = line_dedup.dedup_lines(docs.select("doc_id", "text"), least=1, documents=2)
    assert sorted(((r["doc_id"], r["text"]) for r in few.collect()), key=repr) == sorted(((r[0], r[4]) for r in brute(given, 1, 2)), key=repr)


@pytest.mark.parametrize("share", [2.0, 0.0])
def test_hot_lines(spark, monkeypatch, share):
    """No line is spread, or every one."""
    monkeypatch.setattr(line_dedup, "SHARE", share)
    given = rows()
    got = line_dedup.dedup_lines(spark.createDataFrame(given, "doc_id long, text string").repartition(3))
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(((r[0], r[4]) for r in brute(given)), key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, _lines int, _dropped int")
    got = line_dedup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "_lines", "_dropped"] and got.count() == 0


@pytest.mark.parametrize("at", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_sql_and_brute_force(spark, at):
    con = compare.connection(at)
    assert compare.difference(spark, con, queries.op13_line_dedup, queries.OP13_SQL, at) is None
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    found = [tuple(r) for r in queries.op13_line_dedup(spark, at).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()]
    assert sorted(found, key=repr) == [r[:4] for r in brute(given)]
    assert any(r[2] for r in found)
