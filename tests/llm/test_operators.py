"""The corpus operators against brute force, round trips and held-out accuracy, with odd inputs."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from lustra.llm import chat, fingerprints, hilbert, html_extract, language_id, media, mixing, ngram_join, packing, queries, suffix_dedup
from lustra.llm.suffix_array import suffix_array
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, g string, rank int"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def odd_texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    passage = " ".join(word() for _ in range(80))
    base = [word() for _ in range(150)]
    out = [None, "", " \t\n", "one", "one", "!!! 123", "a" * 900, "b c " * 200, passage, "x " + passage + " y", passage[:199]]
    for k in range(14):
        copy = list(base)
        for _ in range(k):
            copy[r.randrange(150)] = word()
        out.append(" ".join(copy))
    out += [" ".join(base).upper(), passage + " " + " ".join(word() for _ in range(3000)), "日本語 " * 90, "é" * 401]
    return out + [" ".join(word() for _ in range(60)) for _ in range(20)]


def rows_of(texts):
    return [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None, 7, "x", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = rows_of(odd_texts())
    rows += [rows[20], rows[20], (None, "no id", "en", "s1", 5, 1, "x", 1), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_suffix_array():
    r = random.Random(1)
    for _ in range(400):
        s = [r.randrange(r.randint(1, 4)) for _ in range(r.randint(0, 30))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("hot", [16384, 8, 2])
def test_op1(docs, empty, hot):
    every = texts_of(docs)
    count = collections.Counter()
    for _, t in every:
        b = (t or "").encode()
        count.update(b[k : k + 200] for k in range(len(b) - 199))
    expected = []
    for i, t in every:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        expected.append((i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    got = suffix_dedup.suffix_dedup(docs, hot=hot)
    assert got.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    key = lambda x: (x[0] is not None, x[0] or 0, x[4])
    assert sorted([tuple(r[:5]) + (bytes(r[5]),) for r in got.collect()], key=key) == sorted(expected, key=key)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_equal_runs_of_a_row():
    r = np.random.default_rng(3)
    for n, kinds in ((1, 1), (50, 2), (500, 4), (500, 10**6), (64, 1)):
        row, g, c = np.sort(r.integers(0, 5, n)), r.integers(0, kinds, n), r.integers(0, kinds, n)
        expected = collections.defaultdict(list)
        for k, key in enumerate(zip(row.tolist(), g.tolist(), c.tolist())):
            expected[key].append(k)
        *parts, more = suffix_dedup._once_a_row(row, g, c, np.arange(n))
        got = {tuple(k): [at, *(rest or [])] for *k, at, rest in zip(*(x.tolist() for x in parts), more.to_pylist())}
        assert len(got) == len(parts[0]) and {k: sorted(v) for k, v in got.items()} == expected


def test_op1_texts(docs, empty):
    out = suffix_dedup.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.filter("doc_id is null and text is null").count() == 1
    assert suffix_dedup.deduplicated(empty).count() == 0


def test_op2(spark, sf_dir, docs, empty):
    all_docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(all_docs.filter(~queries.held_out()))
    got = language_id.identify(all_docs, model).filter(queries.held_out())
    good = got.filter("lang = lang_pred").count() / got.count()
    assert good > 0.97
    odd = language_id.identify(docs, model, keep=["doc_id", "rank"])
    assert odd.columns == ["doc_id", "rank", "lang_pred", "score"] and odd.count() == docs.count()
    assert {r["lang_pred"] for r in odd.filter("doc_id in (0, 1, 2, 5)").collect()} == {"und"}
    assert odd.filter("score < 0 or score > 1 or score is null").count() == 0
    assert language_id.train(empty) is None
    assert language_id.identify(docs, None).filter("lang_pred <> 'und'").count() == 0


def brute_sketch(text, width=5):
    from lustra.llm.textkit import shingle_set

    h = sorted(int(x) for x in shingle_set(text.encode()))
    return [x for k, x in enumerate(h) if k < 16 or x < (1 << 64) // 8]


def brute_resemblance(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    covered = min((1 << 64) - 1 if len(x) < 16 else max((1 << 64) // 8 - 1, x[15]) for x in (a, b))
    a, b = ({x for x in s if x <= covered} for s in (a, b))
    return len(a & b) / max(1, len(a | b))


@pytest.mark.parametrize("per_range", [2000, 7, 1])
def test_op3(spark, docs, empty, per_range):
    # Rows of one id are ordered by a hash of the text, then the text.
    hashed = {r["t"]: r["h"] for r in docs.selectExpr("coalesce(text, '') t", "xxhash64(coalesce(text, '')) h").collect()}
    every = sorted(((i, t or "") for i, t in texts_of(docs)), key=lambda x: (x[0] is not None, x[0] or 0, hashed[x[1]], x[1]))
    want = collections.Counter()
    for (i, a), (_, b) in zip(every, every[1:] + every[:1]):
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        s, e, n = brute_sketch(a), brute_sketch(edited), brute_sketch(b)
        code = lambda x: fingerprints.encode(np.array(x, dtype=np.uint64))
        want[i, len(a), hashlib.sha256(edited.encode()).hexdigest(), code(s), code(e), round(brute_resemblance(s, e), 9), round(brute_resemblance(s, n), 9)] += 1
    got = fingerprints.neighbour_fingerprints(docs, rows_per_range=per_range).collect()
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == want
    assert fingerprints.neighbour_fingerprints(empty).count() == 0


def test_sketches(docs):
    prints = {}
    for r in fingerprints.fingerprint(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert prints.setdefault(r["text"] or "", r["fingerprint"]) == r["fingerprint"]
    a, b = (" ".join(map(str, range(x, x + 4000))).encode() for x in (0, 1000))
    x, y = fingerprints.sketch(a), fingerprints.sketch(b)
    assert abs(fingerprints.resemblance(x, y) - 0.6) < 0.08 and abs(fingerprints.containment(x, y) - 0.75) < 0.08
    assert (fingerprints.decode(fingerprints.encode(x)) == x).all()
    # Merging two sketches gives the sketch of both texts' shingles, whatever their lengths.
    from lustra.llm.textkit import shingle_set

    r = random.Random(4)
    for k in range(200):
        a, b = (" ".join(str(r.randrange(10**6)) for _ in range(r.choice([0, 3, 6, 12, 20, 60, 400]))).encode() for _ in "ab")
        whole = np.union1d(shingle_set(a), shingle_set(b))
        assert fingerprints.merge(fingerprints.sketch(a), fingerprints.sketch(b)).tolist() == [h for j, h in enumerate(whole.tolist()) if j < 16 or h < (1 << 64) // 8]
    # A short text inside a longer one.
    short, longer = b"a b c d e f g h", b"a b c d e f g h i j"
    assert fingerprints.containment(fingerprints.sketch(short), fingerprints.sketch(longer)) == 1 and abs(fingerprints.resemblance(fingerprints.sketch(short), fingerprints.sketch(longer)) - 4 / 6) < 1e-9


def test_op4(docs, empty):
    got = {(r["doc_id"], r["media_sha256"]): r for r in media.media_features(docs, with_media=True).collect()}
    for i, t in texts_of(docs):
        b = (t or "").encode()
        payload = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        wave = media.to_wave(payload)
        r = got[i, hashlib.sha256(wave).hexdigest()]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"], r["media_bytes"]) == (len(b), len(payload), zlib.crc32(payload[-64:]), len(wave))
        x = list(payload)
        turns = sum((p >= 128) != (q >= 128) for p, q in zip(x, x[1:]))
        assert r["feature"] == f"audio/wav;rate=8000;bits=8;samples={len(x)};sum={sum(x)};energy={sum(v * v for v in x)};crossings={turns};embedded=0"
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and bytes(r["media"]) == wave and r["detected_type"] == "audio/wav"
    assert media.media_features(empty).count() == 0


def test_sniffing():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x4c\x01\x00\x3b"
    import gzip

    packed = gzip.compress(b"hello" * 50)
    finder = media.automaton()
    assert media.detect_type(png, finder) == "image/png" and media.detect_type(gif, finder) == "image/gif" and media.detect_type(packed, finder) == "application/gzip"
    found = media.sniff(b"junk" + png + b"BM ID3 more" + gif + packed + b"\x89PNG\r\n\x1a\nbroken", finder)
    assert [(n, k) for _, n, k in found] == [(len(png), "image/png"), (len(gif), "image/gif"), (len(packed), "application/gzip")]


def test_sniffing_is_linear_and_whole():
    import io
    import time
    import zipfile

    finder = media.automaton()
    began = time.process_time()
    assert media.sniff(b"%PDF-1 " * 150_000, finder) == []
    assert media.sniff(b"PK\x03\x04" * 250_000, finder) == []
    assert media.sniff(b"%PDF-1 %%EOF " * 80_000, finder)[0] == (0, 12, "application/pdf")
    assert time.process_time() - began < 20
    updated = b"%PDF-1.4 one %%EOF two %%EOF"
    assert media.sniff(b"x" + updated + b"  " + updated, finder) == [(1, len(updated), "application/pdf"), (3 + len(updated), len(updated), "application/pdf")]

    def archive(name, data):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            z.writestr(name, data)
        return out.getvalue()

    inner = archive("a", b"text")
    outer = archive("b", inner)
    found = media.sniff(b"junk" + outer + b"junk", finder)
    assert found[0] == (4, len(outer), "application/zip") and (4 + outer.index(inner), len(inner), "application/zip") in found
    import gzip

    two = gzip.compress(b"one") + gzip.compress(b"two")
    assert media.detect_type(two, finder) == "application/gzip"
    frame = b"\xff\xfb\x90\x00" + b"\0" * (144 * 128000 // 44100 - 4)
    mp3 = b"ID3\x03\0\0\0\0\0\0" + frame * 3
    assert media.sniff(b"x" + mp3 + b"tail", finder) == [(1, len(mp3), "audio/mpeg")]
    assert media.sniff(b"ID3\x03\0\0\0\0\0\0" + b"no frame", finder) == []


def test_op5(spark, docs, empty):
    got = hilbert.shard_documents(docs, shards=16)
    rows = got.collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert len(rows) == docs.count() and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    want = sorted((i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts_of(docs))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == want
    assert hilbert.shard_documents(empty).count() == 0
    # A walk along the curve moves by one step in one dimension.
    cells = spark.range(8 * 8 * 8).selectExpr("id % 8 AS x", "(id div 8) % 8 AS y", "id div 64 AS z")
    walk = [(r["x"], r["y"], r["z"]) for r in cells.withColumn("h", hilbert.hilbert_index([cells["x"], cells["y"], cells["z"]], 3)).orderBy("h").collect()]
    assert len(set(walk)) == 512 and all(sum(abs(p - q) for p, q in zip(a, b)) == 1 for a, b in zip(walk, walk[1:]))


def hilbert_number(x, bits):
    """Skilling's transform on plain integers."""
    x, n = list(x), len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for k in range(n):
            if x[k] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[k]) & (q - 1)
                x[0] ^= t
                x[k] ^= t
        q >>= 1
    for k in range(1, n):
        x[k] ^= x[k - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return sum((x[k] >> b & 1) << (b * n + n - 1 - k) for b in range(bits) for k in range(n))


def test_op5_against_brute_force(docs):
    import math

    rows = docs.selectExpr("doc_id", "octet_length(coalesce(text, '')) + 1 AS size", "crc32(coalesce(text, '')) AS crc", "xxhash64(coalesce(text, '')) AS h", "concat('=', lang) AS lang", "concat('=', source) AS source").collect()
    least = {}
    for r in rows:
        for c in ("lang", "source"):
            if r[c] is not None:
                least[r["h"], c] = min(least.get((r["h"], c), r[c]), r[c])
    spread = {r["t"]: r["p"] for r in docs.sparkSession.createDataFrame([(x,) for x in {"", *least.values()}], "t string").selectExpr("t", "pmod(xxhash64(t), 128L) AS p").collect()}
    order = []
    for r in rows:
        cell = [math.floor(math.log2(r["size"]) * 4), *(spread[least.get((r["h"], c), "")] for c in ("lang", "source"))]
        order.append((hilbert_number(cell, 7), r["size"], r["h"], r["doc_id"] is not None, r["doc_id"] or 0, r["crc"]))
    order.sort()
    n, slots, want = len(order), collections.Counter(), []
    for rank, (index, size, _, has, i, crc) in enumerate(order):
        shard = rank * 16 // n
        want.append((i if has else None, size, crc, shard, slots[shard], index))
        slots[shard] += 1
    got = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"], r["hilbert"]) for r in hilbert.shard_documents(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_op5_prunes(spark, sf_dir):
    """Shards cover small parts of the dimensions, where shards of the table's own order cover them all."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    at = hilbert.shard_documents(docs).join(docs.select("doc_id", "lang", "source"), "doc_id")
    whole = docs.select("lang").distinct().count() * docs.select("source").distinct().count()
    pairs = [r["n"] for r in at.groupBy("shard").agg(F.count_distinct("lang", "source").alias("n")).collect()]
    assert sum(pairs) < 0.5 * 16 * whole


def test_op6(docs, empty):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(PATH)
    got = packing.pack_documents(docs, PATH, capacity=128)
    rows = got.collect()
    want = collections.Counter()
    for i, t in texts_of(docs):
        ids = tk.encode(t or "", add_special_tokens=False).ids + [2]
        at, piece = 0, 0
        while at < len(ids):
            stop = at + (len(ids) - at - 1) % 128 + 1
            want[i, piece, at, stop - at, zlib.crc32(np.array(ids[at:stop], dtype="<u4").tobytes())] += 1
            at, piece = stop, piece + 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        end = 0
        for o, n in sorted(b):
            assert o == end
            end += n
        assert end <= 128
    assert len(bins) <= 1.01 * sum(r["length"] for r in rows) / 128 + 1
    assert packing.pack_documents(empty, PATH).count() == 0


def test_tokens_match(monkeypatch):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(PATH)
    odd = ["", "  a", " 's it's we'll 'tis ''s don'T I'd\n\n  x\t\ty  ", "'re'll's", "'", "a 's", "\x1c a\x85b", "a <|endoftext|> b<|endoftext|>c. d", "日本語　x", "😀😀 'm", "½²x 12३", "x " * 50_000, "y" * 20_000]
    r = random.Random(6)
    parts = [" ", "  ", "\n", "\t", "a", "b", "'s", "'", "1", "½", "é", "日", "<|endoftext|>", "\u00a0", "\x1c", "\x85", "!", ".", "\u3000", "😀", "\u180e", "\u200b", "don't", "X", ";:"]
    odd += ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(10_000)]
    tokens = packing.Tokens(PATH)
    want = [e.ids for e in tk.encode_batch(odd, add_special_tokens=False)]
    for _ in range(2):  # unknown and known chunks
        assert [x.tolist() for x in tokens.ids(odd)] == want
    assert 50256 in want[7]
    monkeypatch.setattr(packing, "_KEPT", 1000)  # forgotten again and again
    assert [x.tolist() for k in range(0, len(odd), 500) for x in tokens.ids(odd[k : k + 500])] == want


def test_op7(spark, sf_dir):
    rows = [(1, 1, "assistant", "hi <|im_end|>\n\\ <| x"), (1, 0, "user", None), (1, 1, "assistant", "again"), (2, None, None, "lone"), (None, 0, "a\nb", "t"), (1, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    one = [("user", ""), ("user", ""), ("assistant", "again"), ("assistant", "hi <|im_end|>\n\\ <| x")]
    assert chat.read_back(got[1]["formatted"]) == one and got[1]["n_turns"] == 4
    assert got[1]["loss_sha256"] == hashlib.sha256("".join(t for r, t in one if r == "assistant").encode()).hexdigest()
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in one).encode()).hexdigest()
    assert chat.read_back(got[None]["formatted"]) == [("a\nb", "t")] and got[2]["loss_chars"] == 0
    assert chat.format_conversations(df.limit(0)).count() == 0
    extra = next(r for r in queries.op7_chat(spark, sf_dir).filter("conv_id = -1").collect())
    assert extra["n_turns"] == 2 and extra["loss_chars"] == len(queries._SPELLED)


def test_op7_other_templates(spark):
    rows = [(1, 0, "user", "a", 9), (1, 1, "assistant", "b" * 2_000_000, 9), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    template = "{% for m in messages %}{{ m.role ~ ': ' }}{% if m.role == 'assistant' %}{% generation %}{{ m.text }}{% endgeneration %}{% else %}{{ m.text }}{% endif %}\n{% endfor %}"
    got = {r["conv_id"]: r for r in chat.format_conversations(df, template).collect()}
    assert got[1]["formatted"] == "user: a\nassistant: " + "b" * 2_000_000 + "\n" and got[1]["turns_sha256"] is None
    assert got[1]["n_turns"] == 2 and got[1]["loss_chars"] == 2_000_000 and got[None]["n_turns"] == 1
    for bad in ("{{ 'x' * 999999999 }}", "{% set a = 'xx' %}{{ a * 999999999 }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)({})


def test_template_language():
    text, marks = chat.compile_template("{% set n = 1 + 2 %}{{ n }}{% if n == 3 and not false %}{% generation %}{{ 'a' ~ x.y[0]|upper }}{% endgeneration %}{% else %}no{% endif %}")({"x": {"y": ["b"]}})
    assert text == "3aB" and marks == [(1, 3)]
    assert chat.parse("{{ 1 + 2 }}{% if false %}x{% endif %}") == [("text", "3")]
    for bad in ("{{ x.__class__() }}", "{% import os %}", "{{ x|eval }}", "{% for x in y %}", "{{ 1 + }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    with pytest.raises(chat.TemplateError):
        chat.compile_template("{{ x.real }}")({"x": 1})


PAGE = """<html><head><title>t</title><script>var a="<p>no</p>"</script></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div class="sidebar">Related things to read.</div><article><h1>Title &amp; more</h1><p>First   paragraph <b>bold</b> text,\n quite long.<p>Second &lt;one&gt;.</p><div class="ad">Buy this.</div></article>
<div id="comments"><p>Nice article, thank you for it.</p></div><form><label>Mail</label></form><footer>&copy; us</footer></body></html>"""


def test_scratch_tables_belong_to_their_call(spark, docs):
    import corpus_pipeline

    lazy = mixing.mix(docs)
    now = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[1:3]:
        assert stage(spark, now, "").count() > 0
    assert lazy.count() == docs.count()


def test_pipeline_of_an_empty_table(spark, tmp_path, empty):
    import corpus_pipeline

    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_very_long_text(spark):
    r = random.Random(9)
    long = " ".join(str(r.randrange(10**7)) for _ in range(640_000))
    df = spark.createDataFrame([(1, long, "en", "a"), (2, long[:-40], "en", "a"), (3, None, None, None)], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(df, with_text=False).collect()}
    assert got[2]["n_removed"] == len(long) - 40 and got[1]["n_bytes"] == len(long)
    assert {r["component_id"] for r in ngram_join.linked_components(df).collect()} == {1, 3}
    assert hilbert.shard_documents(df).count() == 3 and mixing.mix(df).count() == 3
    assert {r["doc_id"]: r["n_bytes"] for r in media.media_features(df).collect()}[1] == len(long)
    assert fingerprints.neighbour_fingerprints(df).count() == 3


def test_equal_hashes_and_ids(spark):
    """Texts whose 64-bit hashes agree in their upper halves, under null and equal ids."""
    import corpus_pipeline

    pair = [" ".join(f"{c}{n}" for c in "abcdefgh") for n in (78548, 88238)]
    rows = [(i, t, "en", s, None) for i in (None, 5) for t in pair for s in ("x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicate_stage(spark, df, "")
    assert sorted(r["text"] for r in kept.collect()) == sorted(pair)
    long = [f"{t} " * 40 for t in pair]
    df = spark.createDataFrame([(None, long[0], "en", "x"), (None, pair[1], "en", "x"), (None, long[1], "en", "x")], "doc_id long, text string, lang string, source string")
    got = {r["n_bytes"]: r["n_removed"] for r in suffix_dedup.suffix_dedup(df).collect()}
    assert got[len(pair[1])] == 0


def test_op8(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "old"), (2, "v", None, None), (3, None, "", None), (1, "u", PAGE, "old"), (4, "w", "<p>", None), (5, "x", "<div" + "<" * 500, None)], "page_id long, url string, html string, text string")
    got = [tuple(r) for r in html_extract.extract(df, html_extract.train(df)).select("page_id", "text", "n_chars").collect()]
    want = "Title & more\nFirst paragraph bold text, quite long.\nSecond <one>."
    assert got.count((1, want, len(want))) == 2 and (2, "", 0) in got and (3, "", 0) in got and (4, "", 0) in got
    assert html_extract.extract(df.limit(0), html_extract.train(df.limit(0))).count() == 0


def test_min_cut():
    r = random.Random(2)
    for _ in range(200):
        n = r.randint(1, 7)
        prices = [r.uniform(-2, 2) for _ in range(n)]
        edges = [(r.randrange(n), r.randrange(n), r.uniform(0, 2)) for _ in range(r.randint(0, 9))]

        def cost(lab):
            return sum(-min(p, 0) if x else max(p, 0) for p, x in zip(prices, lab)) + sum(w for a, b, w in edges if lab[a] != lab[b])

        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert abs(cost(html_extract.min_cut(prices, edges)) - best) < 1e-6


def brute_components(every):
    pattern = re.compile(rb"[^\x20\x09-\x0D]+")
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets = []
    for _, t in every:
        w = pattern.findall((t or "").encode().translate(lower))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(every)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(every)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(every):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return collections.Counter((i, len(sets[k]), least.get(find(k), None) if sets[k] else i) for k, (i, _) in enumerate(every))


@pytest.mark.parametrize("block", [256, 2])
def test_op9(docs, empty, block):
    got = ngram_join.linked_components(docs, block=block)
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(texts_of(docs))
    if block == 256:
        assert ngram_join.linked_components(empty).count() == 0


def test_op10(spark, docs, empty):
    got = mixing.mix(docs).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size = collections.Counter()
    for r in got:
        assert r["_size"] == words(r["text"]) and 0 <= r["_copies"] <= 3
        size[r["source"]] += r["_size"]
    targets = {r["source"]: r["_target"] for r in got}
    assert all(r["_source_size"] == size[r["source"]] for r in got)
    assert abs(sum(targets.values()) - sum(size.values())) < 1e-6 * sum(size.values())
    assert all(t <= 3 * size[s] + 1e-9 for s, t in targets.items())
    assert mixing.mix(empty).count() == 0
    again = {(r["doc_id"], r["text"]): r["_copies"] for r in mixing.mix(docs.repartition(5)).collect()}
    assert all(again[r["doc_id"], r["text"]] == r["_copies"] for r in got)
    assert mixing.mixed_rows(docs).columns == docs.columns


def test_op10_sql(spark, sf_dir):
    import compare

    assert compare.difference(spark, compare.connection(sf_dir), queries.op10_mixing, queries.OP10_SQL, sf_dir) is None


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = texts_of(now)
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        after = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert after.columns == plain.columns
        if k == 0:
            assert sorted(map(str, texts_of(after))) == sorted(str(x) for x in before if x[1] and re.search(r"[^\W\d_]", x[1]))
        if k == 1:
            assert after.count() == len({c for _, _, c in brute_components([x for x in before if x[0] is not None])}) + sum(x[0] is None for x in before)
        if k == 2:
            assert after.count() == len(before)
        now = after
    assert now.groupBy("sequence_id").sum("length").filter("`sum(length)` > 1024").count() == 0


def test_near_duplicates_of_odd_ids(spark):
    import corpus_pipeline

    r = random.Random(3)
    text = lambda: " ".join(str(r.randrange(10**6)) for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a), (None, b), (None, b + " end"), (None, c), (7, d), (9, d + " end"), (7, e), (12, e + " end"), (None, None), (None, ""), (8, None), (8, "")]
    rows = [(i, t, "en", "s", None) for i, t in rows] + [(None, "", "en", "other", None), (None, "", "en", "other", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = texts_of(corpus_pipeline.near_duplicate_stage(spark, df, ""))
    assert len(kept) == 10 and kept.count((None, "")) == 2 and {(None, a), (None, c), (7, d), (7, e), (None, None), (None, ""), (8, None), (8, "")} < set(kept)
    comp = {(x["doc_id"], x["_h"]): x["_comp"] for x in ngram_join.linked_components(df).collect()}
    assert len({x for x in comp.values() if x is not None}) == 5


def test_near_duplicates_of_many_null_ids(spark):
    import corpus_pipeline

    # Among so many texts some pairs agree in 32 bits of their hashes.
    df = spark.range(200_000).selectExpr("CAST(NULL AS long) AS doc_id", "concat('t', id) AS text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    assert corpus_pipeline.near_duplicate_stage(spark, df, "").count() == 200_000


def test_language_stage_mends_labels(spark):
    import corpus_pipeline

    all_docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wrong = "doc_id % 20 = 3 AND lang <> 'en'"
    mixed = all_docs.selectExpr("doc_id", "text", f"CASE WHEN {wrong} THEN 'en' WHEN doc_id % 20 <> 4 THEN lang END AS lang", "source", "n_chars", "lang AS truth")
    out = corpus_pipeline.language_stage(spark, mixed, "")
    assert out.columns == mixed.columns and out.filter("lang is null").count() == 0
    assert out.filter(f"{wrong.replace('lang', 'truth')} AND lang = truth").count() > 0.9 * mixed.filter(wrong.replace("lang", "truth")).count()
    assert out.filter("lang <> truth").count() < 0.01 * out.count()


def test_pipeline_with_clashing_columns(spark, tmp_path):
    import corpus_pipeline
    from pyspark.sql import functions as F

    names = "_id _h _hash _own _whole _row lang_pred score target source_size _size _source_size _target _copies _copy _source _s _rest _text _kept a.b".split()
    extra = F.to_json(F.struct("doc_id", "source"))
    now = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars", *[extra.alias(c) for c in names])
    columns = now.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, "").write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert now.columns == columns and now.count() > 0
            assert all(now.filter(~F.col(f"`{c}`").eqNullSafe(extra)).count() == 0 for c in names)
