"""Exact similarity join on word shingles, by a token-group matrix.

Two texts are linked if their sets of five-word shingles have a Jaccard likeness of 0.8 or more;
the result gives each document the least id that links lead to.  Equal sets count once.

1. Bound against everything else: of a set with n shingles, take those of least hash,
   n - ceil(0.8 n) + K(n) of them.  Linked sets share K or more of these, so a set whose short list
   has fewer than K shingles in common with all others together has no link and is done.  So is a
   set of which more than a fifth of all shingles are in no other remaining set.
2. Groups: the remaining sets are parted by their least shared shingle.  Groups are dealt to blocks
   of bounded size, the sets of a block are compared, and linked sets become one component.  Within
   a group components are merged through one representative each, level by level, and groups of
   several blocks are dealt once more by another hash, so that what lay in different blocks meets.
3. Matrix: sets are dealt to blocks again, those of a large component to blocks of their own.  For
   each block, the union of its sets' short lists, and bounds of its sets' sizes and of the partner's
   size that their shared shingles allow.  A set has to share K shingles with a block's union before
   the block is opened; the K - 1 shingles found in most blocks don't open one by themselves, and
   shingles of one component only don't count.  A block of one component isn't asked by it.
   Shingles that lie in the same blocks are one class, counted together: near copies, which have
   most shingles in common, meet a block once for each class and not for each shingle.
4. Opened blocks are compared member by member, and the links found connect components.

Every bound is a necessary condition, so no link is lost; nothing is sampled or capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import discard, written
from .textkit import shingle_sets

#: Most sets, and most shingles in them, in a block that is compared in one task.  A larger set is a
#: block of its own.
BLOCK = 256
SHINGLES = 1 << 20


def _blocks(block: int) -> Column:
    """How many blocks sets of n shingles make."""
    return F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / SHINGLES)).cast("long")


def _need(n: str) -> str:
    """K: of the short lists of two linked sets, the smaller with n shingles, at least so many are shared."""
    return f"(({n}) div 20 + 1)"


def _least_partner(n: str) -> str:
    return f"(({n}) * 4 + 4) div 5"


def _sid(tokens: np.ndarray) -> int:
    """A 64-bit name of a set; 0: the empty set.  Two unlike sets may share one with a chance of 2**-64."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True) if len(tokens) else 0


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            hashes = batch.column(2)
            at, out, held = 0, [], 0
            for k, tokens in enumerate(shingle_sets([t or b"" for t in texts.to_pylist()], width)):
                n = len(tokens)
                sid = _sid(tokens)
                short = None
                if n and sid not in seen:
                    seen.add(sid)
                    if len(seen) > 500_000:
                        seen.clear()
                    short = tokens[: n - -(-4 * n // 5) + n // 20 + 1].view(np.int64)
                    held += len(short)
                out.append((sid, n, short))
                if held > 500_000 or k == len(texts) - 1:
                    sids, ns, lists = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [ids[at : k + 1], hashes[at : k + 1], pa.array(sids, pa.int64()), pa.array(ns, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["_id", "_h", "sid", "n", "short"]
                    )
                    at, out, held = k + 1, [], 0

    return run


_SETS = "sid long, tok long, n long, tokens array<long>, parts long"


def _full_sets(width: int):
    """Rows (sid, tok, n, text, parts) with the text's whole set in the text's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            sid, tok, n, texts, parts = (x.to_pylist() for x in batch.columns)
            for *row, tokens in zip(sid, tok, n, parts, shingle_sets(texts, width)):
                out.append((*row, tokens.view(np.int64)))
                held += len(tokens)
                if held > 500_000:
                    yield _set_batch(out)
                    out, held = [], 0
            if out:
                yield _set_batch(out)

    return run


def _set_batch(out: list[tuple]) -> pa.RecordBatch:
    sid, tok, n, parts, tokens = zip(*out)
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (sid, tok, n)), pa.array(tokens, pa.list_(pa.int64())), pa.array(parts, pa.int64())], names=["sid", "tok", "n", "tokens", "parts"])


def _tokens(x) -> np.ndarray:
    return np.asarray(x, dtype=np.int64).view(np.uint64)


class _Columns:
    """Sets as rows of a sparse matrix over the shingles of a block."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
        row = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(flat, kind="stable")
        self.token, self.row = flat[order], row[order]
        self.left = len(sets)

    def forget(self, gone: np.ndarray) -> None:
        """Leave out the given rows, once they are half of those that remain."""
        stay = len(gone) - int(gone.sum())
        if 2 * stay <= self.left:
            keep = ~gone[self.row]
            self.token, self.row, self.left = self.token[keep], self.row[keep], stay

    def likely(self, tokens: np.ndarray) -> np.ndarray:
        """Rows with a likeness of at least 0.8 to the given sorted set."""
        a = np.searchsorted(self.token, tokens, side="left")
        b = np.searchsorted(self.token, tokens, side="right")
        count = b - a
        total = int(count.sum())
        if not total:
            return np.zeros(0, dtype=np.int64)
        at = np.repeat(a - (np.cumsum(count) - count), count) + np.arange(total)
        both = np.bincount(self.row[at], minlength=len(self.size))
        return np.flatnonzero((both > 0) & (100 * both >= 80 * (self.size + len(tokens) - both)))


def _block_groups(pdf: pd.DataFrame) -> pd.DataFrame:
    """Linked groups of one block: each row's group, named by its least sid, and as the group's
    representative the row through which most of the group was reached.  Representatives of groups
    that are dealt to several blocks keep their shingles for the next level.

    A search from set to set; each one is compared with those not reached yet only.
    """
    pdf = pdf.sort_values("sid").reset_index(drop=True)
    sets = [_tokens(t) for t in pdf.tokens]
    top = np.full(len(sets), -1, dtype=np.int64)
    lead = np.zeros(len(sets), dtype=bool)
    columns = _Columns(sets)
    for seed in range(len(sets)):
        if top[seed] >= 0:
            continue
        top[seed] = seed
        reached, best = [seed], (-1, 0)
        for k in reached:
            near = columns.likely(sets[k])
            near = near[top[near] < 0]
            top[near] = seed
            reached += near.tolist()
            best = max(best, (len(near), -k))
            columns.forget(top >= 0)
        lead[-best[1]] = True
    more = lead & (pdf.parts.to_numpy() > 1)
    return pd.DataFrame({"sid": pdf.sid, "grp": pdf.sid.to_numpy()[top], "tok": pdf.tok, "tokens": [t if m else None for t, m in zip(pdf.tokens, more)]})


def _between(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between the components of one block's sets, as pairs of components."""
    if pdf.grp.nunique() == 1:
        return pd.DataFrame(columns=["a", "b"], dtype="int64")
    both = pdf[["tokens"]].assign(own=pdf.grp)
    return _open(pd.concat([both.assign(inside=True), both.assign(inside=False)]))


def _open(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between questions and the members of a block, as pairs of components."""
    left, right = pdf[pdf.inside], pdf[~pdf.inside]
    found: set[tuple[int, int]] = set()
    if len(left) and len(right):
        columns = _Columns([_tokens(t) for t in left.tokens])
        theirs = left.own.to_numpy()
        for own, tokens in zip(right.own.tolist(), right.tokens):
            found.update((own, c) for c in set(theirs[columns.likely(_tokens(tokens))].tolist()) if c != own)
    return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, root (the least node that edges lead to) of each node in edges (a, b).

    Alternates pulling each node's neighbours to its least neighbour and shortening the way to it;
    every round is written to the shared folder, so lineage stays short.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), name)
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    label = written(label, name)
    while True:
        # Each root learns of the least root next to any of its nodes.
        across = both.join(label.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(label.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        hooks = across.filter("rb < ra").groupBy("ra").agg(F.min("rb").alias("lower"))
        hooks = written(hooks, name)
        if not hooks.head(1):
            discard(both, hooks)
            return label
        # Roots that hook form chains; follow them to the end.
        while True:
            up = hooks.select(F.col("ra").alias("lower"), F.col("lower").alias("next"))
            jumped = written(hooks.join(up, "lower", "left").select("ra", F.coalesce("next", "lower").alias("lower"), F.col("next").isNotNull().alias("moved")), name)
            discard(hooks)
            hooks = jumped
            if not jumped.filter("moved").head(1):
                break
        shorter = written(label.join(hooks.drop("moved"), label["root"] == hooks["ra"], "left").select("node", F.coalesce("lower", "root").alias("root")), name)
        discard(label, hooks)
        label = shorter


def linked_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, block: int = BLOCK) -> DataFrame:
    """One row per input row: ``id_col``, _h (128-bit hash of the text), n_shingles, component_id, _comp.

    component_id is the least id of the component, so null and repeated ids may give several
    components one name; _comp tells them apart.  It is null for rows without shingles.

    Defined cases: texts that are null, empty or without words have no shingles, and are their own
    component even if repeated; with fewer than ``width`` words the whole sequence is the one
    shingle; equal sets are linked whatever their ids; null ids count for nothing as component ids;
    repeated rows are kept; an empty table stays empty; other columns are dropped.
    """
    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("binary").alias("_text"), F.unhex(F.md5(F.col(f"`{text_col}`").cast("binary"))).alias("_h"))
    rows, able = _candidates(keyed, width)
    texts = _texts(keyed, able)
    near = _reachable(able, texts, width)
    discard(able)
    # Groups by the least shared shingle, each dealt to as many blocks as it needs.
    own = near.select("sid", "n", F.array_min("toks").alias("tok"))
    parts = own.groupBy("tok").agg(_blocks(block).alias("parts"))
    dealt = written(own.join(parts, "tok"), "dealt")
    sets = texts.select("sid", "_text").join(dealt.select("sid", "tok", "n", "parts"), "sid").select("sid", "tok", "n", "_text", "parts")
    sets = written(sets.mapInArrow(_full_sets(width), _SETS), "sets")
    discard(texts)
    group = _grouped(sets, block)
    group = _merged(group, _dealt_again(sets, group))
    place = _places(dealt, group, block)
    placed = written(near.join(place, "sid").select("sid", "n", "reach", "grp", "blk", "toks"), "placed")
    discard(near, dealt)
    joined = _across(placed, sets, block)
    discard(placed, sets)
    group = _merged(group, joined)

    # Names: the least id of each set, of each component; a set that is linked with none has its own.
    whole = rows.filter("n > 0").groupBy("sid").agg(F.min("_id").alias("low")).join(group, "sid", "left").select("sid", F.coalesce("grp", "sid").alias("grp"), F.col("grp").isNotNull().alias("g"), "low")
    least_of = written(whole.filter("g").groupBy("grp").agg(F.min("low").alias("least")), "least")
    label = whole.join(least_of, "grp", "left").select("sid", F.when(F.col("g"), F.col("least")).otherwise(F.col("low")).alias("component_id"), F.col("grp").alias("_comp"))
    label = written(label, "labels")
    discard(group, least_of)
    out = rows.join(label, "sid", "left")
    return out.select(F.col("_id").alias(id_col), "_h", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"), "_comp")


def _candidates(keyed: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """All rows (_id, _h, sid, n), and the sets that share enough of their short list with others:
    sid, n, toks (the shared shingles) and one row of each, _id and _h."""
    fields = "_id long, _h binary, sid long, n long, short array<long>"
    signed = written(keyed.mapInArrow(_signatures(width), fields), "signed")
    rows = written(signed.drop("short"), "rows")
    short = signed.filter("short is not null").select("sid", F.explode("short").alias("tok"))
    shared = written(short.groupBy("tok").agg(F.count("*").alias("c")).filter("c > 1").select("tok"), "tokens")
    # A set that several tasks met comes several times; within a task it is sent once.
    lists = short.join(shared.hint("shuffle_hash"), "tok").groupBy("sid").agg(F.collect_set("tok").alias("toks"))
    heads = rows.filter("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.min(F.struct("_id", "_h")).alias("at"))
    able = lists.join(heads, "sid").filter(f"size(toks) >= {_need(_least_partner('n'))}").select("sid", "n", "toks", "at._id", "at._h")
    able = written(able, "able")
    discard(signed, shared)
    return rows, able


def _texts(keyed: DataFrame, able: DataFrame) -> DataFrame:
    """sid, n, _text of one row of each set.  Both sides are dealt by row, so that repeated rows
    lie together and the first one stands for all."""
    same = ["_i", "_null", "_h"]
    row = [F.coalesce("_id", F.lit(0)).alias("_i"), F.col("_id").isNull().alias("_null"), "_h"]
    found = keyed.select(*row, "_text").hint("merge").join(able.select(*row, "sid", "n"), same)
    return written(found.dropDuplicates(same).select("sid", "n", "_text"), "texts")


def _reachable(able: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Sets of ``able`` that may have a partner: sid, n, toks, reach (the most shingles of a partner).

    Shingles that no other of these sets has can't be shared: with n - u of its n shingles a set
    reaches partners of at most 2.25 (n - u) - n shingles, as 0.8 asks for 4/9 of both sizes in
    common, and a partner has at least 0.8 n."""
    sets = texts.select("sid", F.lit(0).cast("long").alias("tok"), "n", "_text", F.lit(1).cast("long").alias("parts")).mapInArrow(_full_sets(width), _SETS)
    alone = sets.select("sid", F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("c"), F.min("sid").alias("sid")).filter("c = 1").groupBy("sid").agg(F.count("*").alias("u"))
    reach = (9 * (F.col("n") - F.coalesce("u", F.lit(0)))) / 4 - F.col("n")
    near = able.select("sid", "n", "toks").join(alone, "sid", "left").select("sid", "n", "toks", reach.alias("reach"))
    return written(near.filter("reach >= n * 0.8"), "near")


def _grouped(sets: DataFrame, block: int) -> DataFrame:
    """sid, grp: sets of one block that are linked.  Groups of several blocks are merged through
    their representatives, level by level, until nothing merges; the matrix decides the rest."""
    level, group, before = sets, None, None
    while True:
        salted = level.withColumn("salt", F.pmod(F.xxhash64("sid"), F.col("parts")))
        solved = written(salted.groupBy("tok", "salt").applyInPandas(_block_groups, "sid long, grp long, tok long, tokens array<long>"), "solved")
        pairs = solved.select("sid", "grp")
        if group is None:
            group = written(pairs, "group")
        else:
            # The groups of representatives carry over to all they stand for.
            up = level.select("sid", "grp0").join(pairs, "sid").select(F.col("grp0").alias("grp"), F.col("grp").alias("up"))
            joined = written(group.join(up, "grp", "left").select("sid", F.coalesce("up", "grp").alias("grp")), "group")
            discard(group, level)
            group = joined
        heads = solved.filter("tokens is not null")
        parts = heads.select("tok", F.size("tokens").alias("n")).groupBy("tok").agg(_blocks(block).alias("parts"))
        left = heads.join(group.select("sid", F.col("grp").alias("grp0")), "sid").select("sid", "tok", "tokens", "grp0").join(parts, "tok")
        left = written(left.select("sid", "tok", "tokens", "grp0", "parts"), "level")
        discard(solved)
        count = left.count()
        if not count or count == before:
            discard(left)
            return group
        level, before = left, count


def _dealt_again(sets: DataFrame, group: DataFrame) -> DataFrame | None:
    """Components of components, by the links that groups of several blocks show when they are dealt
    by another hash."""
    again = sets.filter("parts > 1").join(group, "sid").withColumn("salt", F.pmod(F.xxhash64("sid", F.lit(1)), F.col("parts")))
    found = written(again.groupBy("tok", "salt").applyInPandas(_between, "a long, b long").distinct(), "again")
    joined = components(found, "links") if found.head(1) else None
    discard(found)
    return joined


def _merged(group: DataFrame, joined: DataFrame | None) -> DataFrame:
    """sid, grp: components by what was found to join them."""
    if joined is None:
        return group
    merged = written(group.join(joined, group["grp"] == joined["node"], "left").select("sid", F.coalesce("root", "grp").alias("grp")), "group")
    discard(group, joined)
    return merged


def _places(dealt: DataFrame, group: DataFrame, block: int) -> DataFrame:
    """sid, grp, blk: blocks of the matrix hold sets of like size, of one group or of one component
    that would fill a good part of a block.  Blocks of one component have the higher numbers, so that
    the others ask them and not they the others."""
    large = group.groupBy("grp").agg(F.count("*").alias("m")).filter(F.col("m") * 4 >= block)
    whole = F.col("m").isNotNull()
    home = dealt.join(group, "sid").join(large, "grp", "left")
    home = home.select("sid", "grp", "n", whole.alias("whole"), F.when(whole, F.col("grp")).otherwise(F.col("tok")).alias("of"), F.floor(F.log("n") * 20).alias("step"))
    kind = ["whole", "of", "step"]
    sizes = home.groupBy(*kind).agg(_blocks(block).alias("mb"))
    number = F.shiftrightunsigned(F.xxhash64(*kind, F.pmod(F.xxhash64("sid"), F.col("mb"))), 1)
    return home.join(sizes, kind).select("sid", "grp", F.when(F.col("whole"), number).otherwise(-1 - number).alias("blk"))


def _across(placed: DataFrame, sets: DataFrame, block: int) -> DataFrame | None:
    """Components of components, by all sets that may be linked to another block."""
    need = _need(_least_partner("n"))
    # Shingles that several components have; sets that have enough of them.
    each = placed.select("sid", "grp", F.explode("toks").alias("tok"))
    spread = each.groupBy("tok").agg(F.min("grp").alias("x"), F.max("grp").alias("y")).filter("x < y").select("tok")
    spread = written(spread, "spread")
    lists = each.join(spread, "tok").groupBy("sid").agg(F.collect_list("tok").alias("toks"))
    active = placed.drop("toks").join(lists, "sid").filter(f"size(toks) >= {need}")
    active = written(active, "active")
    discard(spread)
    if not active.head(1):
        return None
    # Classes of shingles, named by two hashes of their blocks.
    held = written(active.select(F.explode("toks").alias("tok"), "blk").distinct(), "held")
    named = [F.bit_xor(F.xxhash64("blk", F.lit(k))).alias(f"c{k}") for k in range(2)]
    classes = written(held.groupBy("tok").agg(F.count("*").alias("wide"), *named), "classes")
    spans = active.groupBy("blk").agg(F.min("n").alias("bmin"), F.max("n").alias("bmax"), F.max("reach").alias("breach"), F.min("grp").alias("gmin"), F.max("grp").alias("gmax"))
    matrix = written(held.join(classes, "tok").select("c0", "c1", "blk").distinct().join(spans, "blk"), "matrix")
    # By falling spread, the classes of the first K - 1 of a set's shingles needn't open a block.
    asks = active.select("sid", "n", "grp", "reach", F.col("blk").alias("own"), F.explode("toks").alias("tok")).join(classes, "tok")
    asks = asks.groupBy("sid", "n", "grp", "reach", "own", "wide", "c0", "c1").agg(F.count("*").alias("w"))
    so_far = F.sum("w").over(Window.partitionBy("sid").orderBy(F.desc("wide"), "c0", "c1"))
    asks = written(asks.withColumn("opens", so_far >= F.expr(need)), "asks")
    discard(held, classes)
    # Of two blocks the one of lower number asks (and each asks itself), if sizes and reach of both allow for a link.
    may = "own <= blk and (gmin <> grp or gmax <> grp) and bmin <= reach and n <= breach and 5 * bmax >= 4 * n and 5 * n >= 4 * bmin"
    found = asks.filter("opens").join(matrix, ["c0", "c1"]).filter(may)
    opened = written(found.groupBy("sid", "blk").agg(F.sum("w").alias("c"), F.first("n").alias("n"), F.first("grp").alias("own")), "opened")
    # The full bound: shared shingles of the short list with the block's union.
    closed = opened.filter(f"c < {need}").join(asks.filter("not opens").select("sid", "c0", "c1", "w"), "sid").join(matrix.select("c0", "c1", "blk"), ["c0", "c1", "blk"])
    more = closed.groupBy("sid", "blk").agg((F.sum("w") + F.first("c")).alias("c"), F.first("n").alias("n"), F.first("own").alias("own"))
    asked = opened.unionByName(more).filter(f"c >= {need}").select("sid", "blk", "n", "own")
    asked = written(asked, "asked")
    discard(matrix, opened, asks)
    if not asked.head(1):
        discard(active, asked)
        return None
    # A block is compared with as many questions as a block may hold in one task; it is sent to as many tasks as its questions need.
    parts = written(asked.groupBy("blk").agg(_blocks(block).alias("qb")), "parts")
    inside = active.select("sid", "blk", F.col("grp").alias("own")).join(parts, "blk").withColumn("qk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qb") - 1))).select("sid", "blk", "qk", "own", F.lit(True).alias("inside"))
    asking = asked.join(parts, "blk").select("sid", "blk", F.pmod(F.xxhash64("sid"), F.col("qb")).alias("qk"), "own", F.lit(False).alias("inside"))
    both = inside.union(asking).join(sets.select("sid", "tokens"), "sid")
    found = written(both.groupBy("blk", "qk").applyInPandas(_open, "a long, b long").distinct(), "found")
    discard(active, asked, parts)
    joined = components(found, "links") if found.head(1) else None
    discard(found)
    return joined
