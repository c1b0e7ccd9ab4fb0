"""Cross-tokenizer alignment against brute force over whole texts."""

import bisect
import collections
import hashlib
import itertools
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from lustra.llm import alignment, queries
from pyspark.sql.types import LongType
from tokenizers import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, a long, groups string, n_a int"


def letters():
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def brute(rows):
    """From byte offsets, all pairs of tokens that overlap."""
    bpe, pieces, table = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), letters()
    bpe.encode_special_tokens = True

    def piece(k):
        p = pieces.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()

    read = []
    for i, text in rows:
        x = y = []
        if text:
            x, y = bpe.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
            u, v = [bytes(table[c] for c in bpe.id_to_token(k)) for k in x], [piece(k) for k in y]
            if not b"".join(u) == b"".join(v) == (" " + text).encode():
                x = y = []
        ends = [list(itertools.accumulate(map(len, s))) for s in (u, v)] if x else [[], []]
        links = []
        for k, e in enumerate(ends[0]):
            start = ends[0][k - 1] if k else 0
            m = bisect.bisect_right(ends[1], start)
            while m < len(y) and (ends[1][m - 1] if m else 0) < e:
                links.append((x[k], y[m]))
                m += 1
        groups, i0, j0 = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            i1, j1 = ends[0].index(e, i0) + 1, ends[1].index(e, j0) + 1
            groups.append(",".join(map(str, x[i0:i1])) + "|" + ",".join(map(str, y[j0:j1])))
            i0, j0 = i1, j1
        read.append((i, len(x), len(y), ";".join(groups), len(groups), links))
    count = collections.Counter(link for r in read for link in r[5])
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for i, n_a, n_b, groups, n, links in read:
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        out.append((i, n_a, n_b, n, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), digest, groups))
    return sorted(out, key=repr)


def rows():
    r = random.Random(11)
    words = "the of and unbelievable don't naïve Straße 日本語の 🤗🏽 <|endoftext|> <s> </s> <unk> <0x41> x▁y ▁ \x00 \x1c \x85 \xa0 　 \n \t \r\n a_b 12345 ... -- İ ﬁ é ´".split(" ")
    out = [None, "", " ", "  ", "\n", " lead", "trail ", "a  b", "a \n b", "no▁good", "▁", "﻿bom", "x" * 500, "日" * 300, " " * 300 + "x", "<|endoftext|>", "a<|endoftext|>b", "\U0010ffff", "é" * 40]
    for _ in range(150):
        out.append("".join(r.choice(words) + r.choice([" ", " ", " ", "", "  ", "\n"]) for _ in range(r.randint(1, 25))))
    for _ in range(150):
        out.append("".join(chr(r.choice([r.randrange(1, 128), r.randrange(1, 0x3000), r.randrange(0x1F300, 0x1F700)])) if r.random() < 0.5 else r.choice("abc de ") for _ in range(r.randint(1, 30))))
    given = list(enumerate(out)) + [(3, "the same again"), (3, "the same again"), (None, "no id"), (None, None)]
    return given + [(5000, " ".join(r.choice(words[:9]) for _ in range(40_000)))]


@pytest.fixture(scope="module")
def expected():
    return brute(rows())


def frame(spark, given):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in given], SCHEMA).repartition(4)


@pytest.mark.parametrize("table", [alignment.TABLE, 100])
def test_against_brute_force(spark, expected, table):
    got = alignment.align_documents(frame(spark, rows()), A, B, table=table)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    found = sorted((tuple(r) for r in got.collect()), key=repr)
    assert found == expected
    assert sum(r[1] > 0 for r in found) > 200 and any(r[4] > r[1] for r in found)


def test_kept_chunks_change_nothing(expected, monkeypatch):
    texts = [t or "" for _, t in rows()]
    for stride, transitions, cuts in ((1_000_000, 200_000, True), (7, 3, True), (100, 10, False)):
        monkeypatch.setattr(alignment, "STRIDE", stride)
        monkeypatch.setattr(alignment, "TRANSITIONS", transitions)
        aligner = alignment.Aligner(A, B)
        assert aligner.cuts
        aligner.cuts = cuts
        spelled = []
        for k in range(0, len(texts), 50):
            aligner.forget()
            for chunks in aligner.read(texts[k : k + 50]):
                bad = aligner.figures[chunks, 4].any()
                spelled.append("" if bad else b";".join(aligner.groups[c] for c in chunks).decode())
        assert sorted(spelled) == sorted(r[8] for r in expected)


def test_forgetting_and_small_slices(expected, monkeypatch):
    """Chunks that a worker forgets, and pairs in many slices."""
    for name, value in (("CHUNKS", 20), ("TOKENS", 200), ("STRIDE", 50), ("PAIRS", 5)):
        monkeypatch.setattr(alignment, name, value)
    alignment._aligner.cache_clear()
    steps = []

    class Frame:  # tasks run in workers, so their functions are called here
        schema = [type("Field", (), {"dataType": LongType()})]

        def mapInArrow(self, run, schema):
            steps.append(run)
            return self

        def select(self, *_):
            return self

        groupBy = agg = select

    docs = Frame()
    alignment.aligned(docs, A, B)
    alignment.pair_counts(docs)
    given = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows()]), pa.array([t for _, t in rows()])], names=["doc_id", "text"])
    parts = list(steps[0](iter([given])))
    assert len(parts) > 50
    got = [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"], r["groups"]) for p in parts for r in p.to_pylist()]
    assert sorted(got, key=repr) == sorted((r[:5] + r[7:] for r in expected), key=repr)
    counts = collections.Counter()
    for batch in steps[1](iter([p.select(alignment._LINKS) for p in parts])):
        for pair, n in zip(*(c.to_pylist() for c in batch.columns)):
            counts[pair] += n
    alignment._aligner.cache_clear()
    assert sum(n * n for n in counts.values()) == sum(r[6] for r in expected)


def test_transducer():
    t = alignment.Transducer([b"ab", b"c", b"", b"abc"], [b"a", b"bc", b"abcabc", b"x"])
    link = lambda *pairs: [a << 32 | b for a, b in pairs]
    for _ in range(2):
        assert t.align([0, 1], [0, 1]) == ([(2, 2)], link((0, 0), (0, 1), (1, 1)))
        assert t.align([3, 0, 1], [2]) == ([(3, 1)], link((3, 2), (0, 2), (1, 2)))
        assert t.align([3, 3], [0, 1, 2]) is None
        assert t.align([], []) == ([], [])
        assert [t.align(*x) for x in (([0], [3]), ([2], []), ([0], []), ([], [0]), ([0], [0]), ([1], [1, 0]))] == [None] * 6
    assert alignment.spelled_groups([5, 6, 7, 8], [1, 2, 3], [(1, 1), (3, 2), (4, 3)]) == "5|1;6,7|2;8|3"


def test_empty_table(spark):
    assert alignment.align_documents(frame(spark, []), A, B).count() == 0


@pytest.mark.parametrize("at", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_brute_force(spark, at):
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_alignment(spark, at)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == [r[:8] for r in brute(given)]
