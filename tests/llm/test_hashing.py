"""Texts whose polynomial hashes agree, and many texts near the threshold of likeness."""

import collections
import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from lustra.llm import chunks, fingerprints, ngram_join, packing, textkit
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
FLIP = str.maketrans("ab", "ba")


def thue_morse(n):
    """A word and its complement; modulo 2**64 their polynomial hashes are equal for any odd base."""
    word = "a"
    while len(word) < n:
        word += word.translate(FLIP)
    return word, word.translate(FLIP)


PAIRS = [thue_morse(n) for n in (1024, 2048, 4096)]
TEXTS = [t for pair in PAIRS for t in pair] + [f"see {t} here and there now" for pair in PAIRS for t in pair]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_words():
    hashes = [h for t in TEXTS for h in textkit.words(t.encode()).tolist()]
    spelled = [w for t in TEXTS for w in t.split()]
    assert len(set(hashes)) == len(set(spelled))
    r = random.Random(2)
    some = {"".join(r.choice("abé") for _ in range(r.randint(1, 200))) for _ in range(3000)}
    assert len({textkit.words(w.encode())[0] for w in some}) == len(some)
    text = " ".join(some)
    assert textkit.words(text.upper().encode()).tolist() == [textkit.words(w.upper().encode())[0] for w in some]


def test_ids(spark, docs):
    plain = Tokenizer.from_file(PATH)
    got = {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in packing.pieces(docs, PATH, capacity=10**6).collect()}
    assert got == {(k, 0): zlib.crc32(np.array(plain.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes()) for k, t in enumerate(TEXTS)}


def test_likeness(spark, docs):
    got = fingerprints.neighbour_fingerprints(docs).orderBy("doc_id").collect()
    for a, b in zip(got, got[1:] + got[:1]):
        assert a["near_next"] == (1.0 if TEXTS[a["doc_id"]] == TEXTS[b["doc_id"]] else 0.0)
    assert len({r["fingerprint"] for r in got}) == len(set(TEXTS))


def test_no_false_links(spark, docs):
    got = ngram_join.linked_components(docs).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got) and len(got) == len(TEXTS)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert sorted(r["text"] for r in kept.collect()) == sorted(TEXTS)


@pytest.mark.parametrize("block,shingles", [(256, 1 << 20), (16, 200)])
def test_thousands_near_the_threshold(spark, monkeypatch, block, shingles):
    monkeypatch.setattr(ngram_join, "SHINGLES", shingles)
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts, family = [], []
    for f in range(220):
        base = [word() for _ in range(r.randint(20, 90))]
        for _ in range(12):
            n = len(base) - 4
            m = max(0, round(n / 9) + r.choice([-1, 0, 0, 0, 1]))
            end = [word() for _ in range(m)]
            texts.append(" ".join(base[: len(base) - m] + end if r.random() < 0.7 else end + base[m:]))
            family.append(f)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    top, near = list(range(len(texts))), 0

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    members = collections.defaultdict(list)
    for k, f in enumerate(family):
        members[f].append(k)
    for group in members.values():
        for i in group:
            for j in group:
                if i < j:
                    both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
                    near += 0.78 <= both / either <= 0.82
                    if 100 * both >= 80 * either:
                        a, b = sorted((find(i), find(j)))
                        top[b] = a
    assert near > 2000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.linked_components(docs, block=block).collect()}
    assert got == {k: find(k) for k in range(len(texts))}


@pytest.fixture(scope="module")
def copies(spark):
    """300 copies that are all linked, and 12 texts that share most shingles with these and, at one
    end, with another of the 12; none of them is linked."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    texts = [base[: -1 - k % 4] + [word() for _ in range(1 + k % 4)] for k in range(300)]
    ends = [[word() for _ in range(14)] for _ in range(12)]
    texts += [ends[k // 2] + base[14:-14] + ends[6 + (k + 1) // 2 % 6] for k in range(12)]
    return spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)


@pytest.fixture
def made(monkeypatch):
    """Rows of the join's tables, in blocks of at most 32 sets."""
    rows, write, linked = collections.defaultdict(int), ngram_join.written, ngram_join.linked_components

    def written(df, name):
        table = write(df, name)
        rows[name] += table.count()
        return table

    monkeypatch.setattr(ngram_join, "written", written)
    monkeypatch.setattr(ngram_join, "linked_components", lambda docs: linked(docs, block=32))
    return rows


def test_a_component_does_not_ask_its_own_blocks(copies, made):
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.linked_components(copies).collect()}
    assert got == {k: k if k >= 300 else 0 for k in range(312)}
    # 10 blocks of copies, asked by 12 texts; each copy asked half of them before, shingle by shingle.
    assert 12 <= made["opened"] < 400
    assert made["matrix"] < 100


def test_the_stage_does_not_ask_them_either(spark, copies, made):
    kept = corpus_pipeline.near_duplicate_stage(spark, copies, "")
    assert sorted(x["doc_id"] for x in kept.collect()) == [0, *range(300, 312)]
    assert 12 <= made["opened"] < 400


def test_cut():
    r = random.Random(6)
    spaces = [c for c in map(chr, range(0x110000)) if c.isspace()]
    texts = ["", " ", "a", "a b", " a b", "a b ", "a  b c", "a\n b c", "é\u3000 b c"]
    texts += ["".join(r.choice(["a", "é", " ", r.choice(spaces)]) for _ in range(r.randint(0, 9))) for _ in range(5000)]
    order, heads, rest, count = chunks.cut(texts)
    assert sorted(order) == list(range(len(texts)))
    ends = np.cumsum(count)
    got = {k: [head, *rest[end - n : end].to_pylist()] for k, head, n, end in zip(order, heads, count, ends)}
    assert got == {k: chunks.CUT.split(t) for k, t in enumerate(texts)}


def test_chunks_are_looked_up_once(monkeypatch):
    looked, of = [], packing.Numbers.of
    monkeypatch.setattr(packing.Numbers, "of", lambda self, parts, start: looked.extend(parts) or of(self, parts, start))
    texts = ["to be or not to be that is  the question " * 300, " be to", "", "to be or not " * 200 + "x"]
    got = packing.Tokens(PATH).ids(texts)
    plain = Tokenizer.from_file(PATH)
    assert [x.tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(looked) < 30
