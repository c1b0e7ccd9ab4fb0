"""Aligning two tokenizers' tokens over the same bytes: a dangling-suffix transducer.

It reads both token sequences and keeps track of which side leads and of the bytes that the other
side hasn't matched yet (the residual).  A token of the side behind is taken off the residual, or
takes the lead with what it has more.  An empty residual closes a group.  Transitions are kept by
lead, residual and next token.  Each token met while a residual is open overlaps the leading token:
these are the links.

Texts are read in chunks: a single space between two characters that aren't white space starts a
token on both sides, so a group closes there, and a chunk is aligned once for all its occurrences.
Tokenizers for which that isn't sure are given whole texts.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .chunks import CUT, Numbers, ids_after_cuts, token_sizes
from .scratch import discard, written

#: Most chunks, and most tokens in them, that a worker keeps; most transitions.
CHUNKS, TOKENS, TRANSITIONS = 300_000, 3_000_000, 200_000
#: Characters that are cut at a time.
STRIDE = 1_000_000
#: Most pairs of ids in a broadcast table (17 bytes each).  More pairs make more tables, one pass each.
TABLE = 1 << 21
#: Pairs that are counted, and handed on, at a time.
PAIRS = 1 << 20


def _byte_of_letter() -> dict[str, int]:
    """Byte-level spelling: printable bytes stand for themselves, the others for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE file of ``tokenizers``.  Special tokens' strings are plain text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        #: Whether a space between characters that aren't white space always starts a token.
        self.cuts = bool(plain and not spec.get("normalizer") and all(t["special"] for t in spec.get("added_tokens", [])))
        letters = _byte_of_letter()
        self.spelled = [bytes(letters[c] for c in self.tokenizer.id_to_token(k)) if all(c in letters for c in self.tokenizer.id_to_token(k)) else self.tokenizer.id_to_token(k).encode() for k in range(self.tokenizer.get_vocab_size())]

        self.sizes = token_sizes(self.tokenizer) if self.cuts else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self.cuts:
            return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        ids, counts = ids_after_cuts(self.tokenizer, self.sizes, texts)
        ends, ids = np.cumsum(counts).tolist(), ids.tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]


class Pieces:
    """A ``sentencepiece`` model, which adds the leading space itself."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(self.model.serialized_model_proto())
        rule, names = spec.normalizer_spec, [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        same = rule.name == "identity" and not rule.precompiled_charsmap and rule.add_dummy_prefix and rule.escape_whitespaces and not rule.remove_extra_whitespaces
        # No piece goes on after a space that follows something else, and no character is unknown.
        self.cuts = bool(same and spec.trainer_spec.byte_fallback and not any("▁" in n.lstrip("▁") for n in names))
        self.spelled = [bytes([int(n[3:5], 16)]) if self.model.is_byte(k) else n.replace("▁", " ").encode() for k, n in enumerate(names)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def tokenizer(path: str) -> ByteLevel | Pieces:
    """By the file's ending: ``.json`` for tokenizers, ``.model`` for sentencepiece."""
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


class Transducer:
    """Aligns sequences of two vocabularies, given as the bytes of each id."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.spelled, self.memo = (a, b), {}

    def step(self, lead: int, rest: bytes, token: int) -> tuple[int, bytes] | None:
        """The next lead and residual when the other side's ``token`` comes; None if bytes differ."""
        key = (lead, rest, token)
        if key in self.memo:
            return self.memo[key]
        word = self.spelled[1 - lead][token]
        if not word or not (word.startswith(rest) or rest.startswith(word)):
            after = None
        elif len(word) > len(rest):
            after = 1 - lead, word[len(rest) :]
        else:
            after = lead, rest[len(word) :]
        if len(self.memo) >= TRANSITIONS:
            self.memo.clear()
        self.memo[key] = after
        return after

    def align(self, a: list[int], b: list[int]) -> tuple[list[tuple[int, int]], list[int]] | None:
        """Where groups end (places in a and b), and links (id of a << 32 | id of b), in order; None if
        the bytes differ."""
        first, known = self.spelled[0], self.memo.get
        groups, links = [], []
        i = j = 0
        try:
            while i < len(a):
                lead, of_a = 0, a[i]
                rest = first[of_a]
                i += 1
                if not rest:
                    return None
                while rest:
                    if lead:
                        token = of_a = a[i]
                        i += 1
                    else:
                        token = of_b = b[j]
                        j += 1
                    links.append(of_a << 32 | of_b)
                    after = known((lead, rest, token)) or self.step(lead, rest, token)
                    if after is None:
                        return None
                    lead, rest = after
                groups.append((i, j))
        except IndexError:  # one side ends before the other
            return None
        return (groups, links) if j == len(b) else None


def spelled_groups(a: list[int], b: list[int], ends: list[tuple[int, int]]) -> str:
    """``a1,a2|b1;a3|b2,b3``"""
    out = []
    x = y = 0
    for i, j in ends:
        if i - x == 1 == j - y:
            out.append(f"{a[x]}|{b[y]}")
        else:
            out.append(f"{','.join(map(str, a[x:i]))}|{','.join(map(str, b[y:j]))}")
        x, y = i, j
    return ";".join(out)


class Aligner:
    """Alignments of texts, chunk by chunk.  ``figures`` has a row for each chunk that is kept:
    tokens of a and b, groups, links and bad (1 if the bytes differ)."""

    def __init__(self, a: str, b: str):
        self.sides = tokenizer(a), tokenizer(b)
        self.cuts = all(s.cuts for s in self.sides)
        self.transducer = Transducer(*(s.spelled for s in self.sides))
        self.number = Numbers()
        self.groups: list[bytes] = []
        self.figures = np.zeros((1024, 5), dtype=np.int64)
        self.pairs: list[np.ndarray] = []
        self.seen = np.zeros(1024, dtype=np.int64)
        self.tokens = 0

    def forget(self) -> None:
        """Keep the chunks that were met more than once since the last time, at most half as many as
        there may be; numbers change."""
        often = np.flatnonzero(self.seen > 1)
        if len(often) > CHUNKS // 2:
            often = np.sort(often[np.argsort(-self.seen[often], kind="stable")[: CHUNKS // 2]])
        if 2 * int(self.figures[often, :2].sum()) > TOKENS:
            often = often[:0]
        names = list(self.number)
        self.number = Numbers({names[k]: n for n, k in enumerate(often.tolist())})
        self.groups = [self.groups[k] for k in often.tolist()]
        self.pairs = [self.pairs[k].copy() for k in often.tolist()]
        self.figures = np.concatenate([self.figures[often], np.zeros((1024, 5), dtype=np.int64)])
        self.seen = np.zeros(len(self.figures), dtype=np.int64)
        self.tokens = int(self.figures[:, :2].sum())

    @property
    def full(self) -> bool:
        return len(self.number) > CHUNKS or self.tokens > TOKENS

    def _learn(self, new: list[str]) -> None:
        start = len(self.number) - len(new)
        while len(self.number) > len(self.figures):
            self.figures = np.concatenate([self.figures, np.zeros_like(self.figures)])
            self.seen = np.concatenate([self.seen, np.zeros_like(self.seen)])
        rows, flat, sizes, align, spelled = [], [], [], self.transducer.align, self.sides[0].spelled
        for part, a, b in zip(new, *(s.encode(new) for s in self.sides)):
            # The transducer compares b's bytes with a's.
            whole = b"".join([spelled[t] for t in a]) == (" " + part).encode("utf-8", "replace")
            found = align(a, b) if whole else None
            groups, links = found or ([], [])
            flat += links
            sizes.append(len(links))
            self.groups.append(spelled_groups(a, b, groups).encode())
            rows.append((len(a), len(b), len(groups), len(links), found is None))
        figures = self.figures[start : start + len(new)]
        figures[:] = rows
        self.tokens += int(figures[:, :2].sum())
        pairs = np.array(flat, dtype=np.int64)
        self.pairs += np.split(pairs, np.cumsum(sizes)[:-1])

    def read(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The numbers of each text's chunks."""
        done: list[np.ndarray] = []
        parts: list[str] = []
        sizes: list[int] = []
        held = 0

        def learnt() -> None:
            nonlocal held
            done.append(self.number.of(parts, len(self.number)))
            if self.number.new:
                self._learn(self.number.new)
            self.seen += np.bincount(done[-1], minlength=len(self.seen))
            parts.clear()
            held = 0

        for text in texts:
            at = size = 0
            while at < len(text):
                cut = CUT.search(text, at + STRIDE) if self.cuts else None
                stop, after = cut.span() if cut else (len(text), len(text))
                more = CUT.split(text[at:stop]) if self.cuts else [text]
                parts += more
                size, held, at = size + len(more), held + stop - at, after
                if held > STRIDE:
                    learnt()
            sizes.append(size)
        learnt()
        every, at = np.concatenate(done), 0
        for size in sizes:
            yield every[at : at + size]
            at += size


@lru_cache(1)
def _aligner(a: str, b: str) -> Aligner:
    """Kept by a worker over its tasks."""
    return Aligner(a, b)


def _groups_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts, some million characters at a time."""
    for batch in batches:
        keys: list = []
        texts: list[str] = []
        held = 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            keys.append(key)
            texts.append(text.as_py() or "")
            held += len(texts[-1])
            if held > STRIDE:
                yield keys, texts
                keys, texts, held = [], [], 0
        if keys:
            yield keys, texts


_FIGURES = ["n_a", "n_b", "n_groups", "n_links"]
_LINKS = ["link_a", "link_b", "link_n"]


def aligned(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups (if asked for), and a text's linked
    pairs of ids with the number of its links that hold them: link_a, link_b, link_n."""
    kind = docs.select(f"`{id_col}`").schema[0].dataType
    extra = ["groups"] if with_groups else []
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a, b)

        def rows(keys: list, figures: list, texts: list[bytes], pairs: list[np.ndarray], times: list[np.ndarray]) -> pa.RecordBatch:
            ends = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
            flat = np.concatenate(pairs)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (flat >> 32, flat & 0xFFFFFFFF, np.concatenate(times))]
            digests = pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in texts], pa.string())
            spelled = [pa.array([t.decode() for t in texts], pa.string())] if with_groups else []
            return pa.RecordBatch.from_arrays([pa.array(keys, id_type), *map(pa.array, np.array(figures).T), digests, *spelled, *lists], names=["doc_id", *_FIGURES, "groups_sha256", *extra, *_LINKS])

        nothing = np.zeros(0, dtype=np.int64)
        for keys, texts in _groups_of_texts(batches):
            if aligner.full:
                aligner.forget()
            out: list[tuple] = []
            held = 0
            for key, chunks in zip(keys, aligner.read(texts)):
                figures, groups, pairs, times = aligner.figures[chunks].sum(axis=0), b"", nothing, nothing
                if len(chunks) and not figures[4]:
                    mine = chunks.tolist()
                    groups = b";".join(map(aligner.groups.__getitem__, mine))
                    pairs, times = np.unique(np.concatenate(list(map(aligner.pairs.__getitem__, mine))), return_counts=True)
                out.append((key, figures[:4] if groups else np.zeros(4, dtype=np.int64), groups, pairs, times))
                held += len(pairs)
                if held > PAIRS:
                    yield rows(*zip(*out))
                    out, held = [], 0
            if out:
                yield rows(*zip(*out))

    schema = f"doc_id {kind.simpleString()}, " + "".join(f"{n} long, " for n in _FIGURES) + "groups_sha256 string, " + ("groups string, " if with_groups else "") + ", ".join(f"{n} array<int>" for n in _LINKS)
    read = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return read.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows with some million pairs at a time: the rows, where each one's pairs end, keys and times.
    The last three columns are those of :data:`_LINKS`."""
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + PAIRS, "right")) - 1)
        part = batch.slice(at, stop - at)
        a, b, times = (part.column(part.num_columns - k).flatten().to_numpy().astype(np.int64) for k in (3, 2, 1))
        yield part, ends[at : stop + 1] - ends[at], a << 32 | b, times
        at = stop


def pair_counts(found: DataFrame) -> DataFrame:
    """pair (id of a << 32 | id of b), n: how many links of all texts of :func:`aligned` hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, keys, times in _slices(batch):
                order = np.argsort(keys, kind="stable")
                keys, times = keys[order], times[order]
                first = np.flatnonzero(np.diff(keys, prepend=-1))
                if len(first):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array(np.add.reduceat(times, first))], names=["pair", "n"])

    return found.select(*_LINKS).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align_documents(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = True, table: int = TABLE) -> DataFrame:
    """For each document: its id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair is
    among the most frequent ones of its b id), count_sum (of the pairs' counts over all documents, for
    each link), groups_sha256 and, if asked for, groups: ``a1,a2|b1;a3|b2,b3`` in decimal ids.

    ``a`` and ``b`` are files for :func:`tokenizer`; both read a space and the text.  Texts are
    aligned once, and their pairs written.  The table of pair counts is at most the product of the
    vocabularies; it is broadcast in parts of at most ``table`` pairs, with a pass over the written
    pairs for each, whose sums are added up.

    Defined cases: texts that are null or empty, or whose tokens don't spell the space and the text
    in both vocabularies, have zeros and empty strings; null ids are kept; repeated rows count and
    come back as often as they came; an empty table gives no row; other columns are dropped.
    """
    spark = docs.sparkSession
    found = written(aligned(docs, a, b, id_col, text_col, with_groups), "aligned")
    counts = written(pair_counts(found), "pairs")
    tables = max(1, -(-counts.count() // table))
    of_b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    best = (F.col("n") == F.max("n").over(Window.partitionBy(of_b))).cast("byte").alias("best")
    ranked = written(counts.select("pair", "n", best, F.pmod(F.xxhash64("pair"), F.lit(tables)).alias("part")), "ranked")
    discard(counts)

    names = [c for c in found.columns if c not in _LINKS]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name in names) + ", n_best long, count_sum long"

    def one(part: int) -> DataFrame:
        rows = ranked.filter(F.col("part") == part).orderBy("pair").select("pair", "n", "best").toArrow().combine_chunks()
        shared = spark.sparkContext.broadcast([np.ascontiguousarray(c.to_numpy()).tobytes() for c in rows.columns])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs, counts, tops = (np.frombuffer(x, t) for x, t in zip(shared.value, (np.int64, np.int64, np.int8)))
            for batch in batches:
                for rows, ends, keys, times in _slices(batch):
                    at = np.minimum(np.searchsorted(pairs, keys), max(len(pairs) - 1, 0))
                    times = np.where(pairs[at] == keys, times, 0) if len(pairs) else times[:0]
                    sums = [np.concatenate([[0], np.cumsum(x[at] * times)])[ends] for x in (tops, counts)] if len(pairs) else [np.zeros(len(ends), dtype=np.int64)] * 2
                    yield pa.RecordBatch.from_arrays([*rows.columns[: len(names)], *(pa.array(np.diff(s)) for s in sums)], names=[*names, "n_best", "count_sum"])

        return found.mapInArrow(run, schema)

    parts = [one(k).withColumn("_part", F.lit(k)) for k in range(tables)]
    discard(ranked)
    out = parts[0].drop("_part")
    if tables > 1:
        # Rows with the same id and groups have the same sums in each pass.
        both = reduce(DataFrame.unionByName, parts).groupBy(*names).agg(F.count_if(F.col("_part") == 0).alias("_times"), F.sum("n_best").alias("_best"), F.sum("count_sum").alias("_sum"))
        out = both.select("*", *[F.call_function("div", F.col(c), F.col("_times")).alias(n) for c, n in (("_best", "n_best"), ("_sum", "count_sum"))])
        out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    return out.select(F.col("doc_id").alias(id_col), *_FIGURES, "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else []))
