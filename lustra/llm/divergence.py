"""How far the sources of a language differ in their words: a two-pass vocabulary automaton.

The first pass counts exact document frequencies and keeps the terms of enough documents.  The second
runs Aho-Corasick over the texts with the kept terms padded by delimiters and counts their
occurrences in each group (a language and a source).  What doesn't occur isn't stored: postings
(group, term, count) give the shares, the sums for pairs of sources and the ranked terms, with whole
numbers only.

The vocabulary reaches the tasks in blocks of at most ``BLOCK`` bytes of terms, one broadcast at a
time; a block's texts are those of its languages.  More terms make more blocks, never larger ones.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import discard, written

#: Most bytes of terms in one automaton.  A longer term is a block of its own.
BLOCK = 2 << 20
#: Most entries that a task counts before it hands them on.
HELD = 500_000
#: Pairs of postings that a task compares at a time.
PAIRS = 1 << 21

#: Terms are what delimiters leave: [^\x00-\x40\x5B-\x60\x7B-\x7F]+ on bytes; A-Z are lowered.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _batch(schema: dict[str, pa.DataType], columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.values())], names=list(schema))


def _read(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    names = {"lang": lang_col, "source": source_col, "text": text_col}
    return docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(k) for k, c in names.items()])


def document_frequencies(docs: DataFrame) -> DataFrame:
    """lang, term (UTF-8 bytes), n: how many rows of ``docs`` (lang, text) hold the term.  Tasks add up
    before they hand on."""
    schema = {"lang": pa.string(), "term": pa.binary(), "n": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                yield _batch(schema, [[lang] * len(counts), list(counts), list(counts.values())])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = held.setdefault(lang, Counter())
                before = len(counts)
                counts.update(set(terms(text.as_py())))
                size += len(counts) - before
                if size > HELD:
                    yield from rows()
                    size = 0
        yield from rows()

    found = docs.select("lang", F.col("text").cast("binary")).mapInArrow(run, "lang string, term binary, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n"))


@lru_cache(1)
def _automata(vocabulary) -> dict:
    """An automaton for each language of a block; a worker keeps the last block's."""
    import ahocorasick

    out = {}
    for lang, words in vocabulary.value.items():
        found = out[lang] = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, word in enumerate(words):
            found.add_word(f" {word.decode('latin-1')} ", k)
        found.make_automaton()
    return out


def occurrences(docs: DataFrame, vocabulary) -> DataFrame:
    """lang, source, term, n of the terms in a broadcast {lang: [terms]}.  Texts are read as bytes, a
    letter for each; padded terms may share a delimiter, as matches may overlap."""
    schema = {"lang": pa.string(), "source": pa.string(), "term": pa.binary(), "n": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata(vocabulary)
        held: dict[tuple[str, str], Counter] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in held.items():
                words = vocabulary.value[lang]
                yield _batch(schema, [[lang] * len(counts), [source] * len(counts), [words[k] for k in counts], list(counts.values())])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if lang not in automata:
                    continue
                padded = f" {text.as_py().translate(_FOLD).decode('latin-1')} "
                counts = held.setdefault((lang, source), Counter())
                before = len(counts)
                counts.update(map(itemgetter(1), automata[lang].iter(padded)))
                size += len(counts) - before
                if size > HELD:
                    yield from rows()
                    size = 0
        yield from rows()

    found = docs.select("lang", "source", F.col("text").cast("binary")).mapInArrow(run, "lang string, source string, term binary, n long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def _blocks(sizes: list[tuple[str, int]], block: int) -> list[tuple[str, int, int, int]]:
    """(lang, parts, part, number of block): large languages are cut into parts, small ones share."""
    out, number, used = [], 0, 0
    for lang, size in sizes:
        parts = -(-size // block)
        for part in range(parts):
            if used and used + size / parts > block:
                number, used = number + 1, 0
            out.append((lang, parts, part, number))
            used += size / parts
    return out


def count_kept(docs: DataFrame, kept: DataFrame, block: int = BLOCK) -> tuple[DataFrame, list[DataFrame]]:
    """Occurrences of the kept terms (lang, term), block by block; and the tables written for it."""
    spark = docs.sparkSession
    # One row for each language: how many bytes its automaton reads.
    sizes = kept.groupBy("lang").agg(F.sum(F.length("term") + 2).alias("size")).orderBy("lang").collect()
    cut = _blocks([(r["lang"], r["size"]) for r in sizes], block)
    tables = []
    for number in range(cut[-1][3] + 1 if cut else 0):
        mine = [(lang, parts, part) for lang, parts, part, k in cut if k == number]
        units = F.broadcast(spark.createDataFrame(mine, "_lang string, _parts int, _part int"))
        here = (F.col("lang") == F.col("_lang")) & (F.pmod(F.xxhash64("term"), "_parts") == F.col("_part"))
        vocabulary: dict[str, list[bytes]] = {}
        for lang, term in zip(*(c.to_pylist() for c in kept.join(units, here).select("lang", "term").toArrow().columns)):
            vocabulary.setdefault(lang, []).append(term)
        shared = spark.sparkContext.broadcast(vocabulary)
        tables.append(written(occurrences(docs.filter(F.col("lang").isin(list(vocabulary))), shared), "occurrences"))
        shared.destroy()
    none = spark.createDataFrame([], "lang string, source string, term binary, n long")
    return reduce(DataFrame.unionByName, tables, none), tables


def share(count: Column, total: Column, distinct: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 distinct)), in decimals; null without kept terms."""
    part = (count + 5).cast("decimal(18,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    whole = F.when(distinct > 0, (total + distinct * 5).cast("decimal(18,0)"))
    return F.call_function("div", part, whole) + 1


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From each term's postings: by how much a pair of sources that both have the term differs from
    what the sums over each one's own terms say, added up within the batch."""
    schema = {"lang": pa.string(), "source": pa.string(), "item": pa.string(), "value": pa.int64()}
    for batch in batches:
        langs, lists = batch.column(0).dictionary_encode(), batch.column(1)
        flat = lists.flatten()
        if not len(flat):
            continue
        sizes = np.diff(lists.offsets.to_numpy())
        ends = np.repeat(np.cumsum(sizes), sizes)
        source = flat.field("source").dictionary_encode()
        p, base, code = flat.field("p").to_numpy(), flat.field("base").to_numpy(), source.indices.to_numpy().astype(np.int64)
        kinds = len(source.dictionary)
        lang = np.repeat(langs.indices.to_numpy().astype(np.int64), sizes)
        partners = ends - np.arange(len(flat)) - 1
        before = np.cumsum(partners)
        at = 0
        while at < len(flat):
            stop = max(at + 1, int(np.searchsorted(before, (before[at - 1] if at else 0) + PAIRS, "right")))
            own = partners[at:stop]
            a = np.repeat(np.arange(at, stop), own)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(own) - own, own)
            at = stop
            if not len(a):
                continue
            value = np.abs(p[a] - p[b]) - np.abs(p[a] - base[b]) - np.abs(base[a] - p[b]) + np.abs(base[a] - base[b])
            key = (lang[a] * kinds + code[a]) * kinds + code[b]
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sums, key = np.add.reduceat(value[order], first), key[first]
            names = [langs.dictionary.take(pa.array(key // kinds // kinds)), source.dictionary.take(pa.array(key // kinds % kinds)), source.dictionary.take(pa.array(key % kinds)), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(names, names=list(schema))


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 30, top: int = 50, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank.

    A term is a run of letters A-Z and characters beyond ASCII, A-Z lowered.  A language keeps the
    terms of at least ``least`` of its documents.  A group's share p of a kept term is
    :func:`share` of its count among the group's counts of kept terms.  Part ``pair``: the sum of
    the differences of p over all kept terms, for each other source (item) of the language.  Part
    ``term``: by how much p is above the language's own share, for the ``top`` terms (item) that the
    group has.  Ranks go by value, falling, then by UTF-8 bytes of the item.

    Defined cases: null text, language and source are empty ones; a group without kept terms has
    counts of 0; where a language keeps none, all pairs have value 0 and there are no terms;
    repeated rows are documents of their own; a source that is alone in its language has no pairs;
    an empty table gives no row; other columns are ignored, whatever their names.
    """
    read = _read(docs, text_col, lang_col, source_col)
    kept = written(document_frequencies(read).filter(F.col("n") >= least).select("lang", "term"), "kept")
    counts, tables = count_kept(read, kept, block)

    by_lang, by_group = Window.partitionBy("lang"), Window.partitionBy("lang", "term")
    present = counts.groupBy("lang", "source").agg(F.sum("n").alias("_total"), F.count("*").alias("_terms"))
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("_kept"))
    groups = read.select("lang", "source").distinct().join(present, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0, ["_total", "_terms", "_kept"])
    groups = groups.withColumn("base", share(F.lit(0), F.col("_total"), F.col("_kept")))
    groups = groups.withColumn("_most", F.max("base").over(by_lang)).withColumn("_all", F.sum("_total").over(by_lang))
    groups = written(groups, "groups")

    shares = counts.withColumn("_whole", F.sum("n").over(by_group)).join(groups, ["lang", "source"])
    shares = shares.select(
        "lang", "source", "term", "base", "_most", share(F.col("n"), F.col("_total"), F.col("_kept")).alias("p"), share(F.col("_whole"), F.col("_all"), F.col("_kept")).alias("q"),
    )
    postings = written(shares, "postings")
    discard(kept, *tables)

    # |p - base| over a source's own terms, for each other source's base.  Where p is no less than any
    # base of the language the difference is linear, and one sum does for all; few counts are below.
    low = F.when(F.col("p") < F.col("_most"), F.col("p"))
    own = postings.groupBy("lang", "source", low.alias("_p")).agg(F.count("*").alias("_n"), F.sum("p").alias("_sum"))
    other = groups.select(F.col("lang").alias("_l"), F.col("source").alias("item"), F.col("base").alias("_base"), F.col("_terms").alias("_others"))
    met = (F.col("lang") == F.col("_l")) & (F.col("source") != F.col("item"))
    apart = F.when(F.col("_p").isNull(), F.col("_sum") - F.col("_n") * F.col("_base")).otherwise(F.col("_n") * F.abs(F.col("_p") - F.col("_base")))
    alone = own.join(other, met).groupBy("lang", "source", "item").agg(F.sum(apart).alias("value"))
    lists = postings.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "base")).alias("found"))
    both = lists.select("lang", "found").mapInArrow(_both, "lang string, source string, item string, value long")
    one_way = alone.unionByName(both)
    turned = one_way.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    # Terms that neither has; these rows are also the pairs themselves.
    neither = (F.col("_kept") - F.col("_terms") - F.col("_others")) * F.abs(F.col("base") - F.col("_base"))
    pairs = groups.join(other, met).select("lang", "source", "item", F.coalesce(neither, F.lit(0)).alias("value"))
    pairs = pairs.unionByName(one_way).unionByName(turned).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))

    over = postings.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"), F.lit("term").alias("part"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    listed = over.withColumn("rank", place).filter(F.col("rank") <= top).withColumn("item", F.col("item").cast("string"))
    every = pairs.withColumn("rank", place).unionByName(listed)
    return every.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
