"""Chunks of texts that byte-level tokenizers encode by themselves: cuts, and the ids of many chunks."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A plain space between two characters that aren't white space: it always starts a pre-token of the
#: byte-level pattern, so that a text can be cut there without a change of ids.
CUT = re.compile(r" (?<=\S )(?=\S)")
_OTHERS = "".join(rf"\x{{{ord(c):x}}}" for c in map(chr, range(0x110000)) if c.isspace() and c != " ")
#: Texts with a space that isn't a cut, for Arrow's regular expressions, which know ASCII white space only.
_ODD = rf"\A | \z|  |[{_OTHERS}] | [{_OTHERS}]"
#: Chunks that are encoded in one go; fewer calls for short chunks, but long texts are slower again.
TOGETHER = 64


def cut(texts: list[str]) -> tuple[np.ndarray, list[str], pa.Array, np.ndarray]:
    """Chunks by ``CUT``: an order of the texts, and in that order their first chunks, their later
    ones one after the other, and how many later ones each has.  Arrow splits the texts of which each
    space is a cut."""
    column = pa.array(texts, pa.large_string())
    odd = pc.match_substring_regex(column, _ODD).to_numpy(zero_copy_only=False)
    split = pc.split_pattern(column.filter(pa.array(~odd)), " ")
    size = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = split.flatten()
    first = np.zeros(len(flat), dtype=bool)
    first[np.cumsum(size) - size] = True
    heads, rest = flat.filter(pa.array(first)).to_pylist(), flat.filter(pa.array(~first))
    order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
    others = [CUT.split(texts[k]) for k in np.flatnonzero(odd)]
    if others:
        rest = pa.concat_arrays([rest, pa.array([c for chunks in others for c in chunks[1:]], pa.large_string())])
    count = np.append(size, np.array([len(chunks) for chunks in others], dtype=np.int64)) - 1
    return order, heads + [chunks[0] for chunks in others], rest, count


class Numbers(dict):
    """Numbers of chunks; one that isn't known gets the next and is listed in ``new``."""

    def __init__(self, known: dict[str, int] | None = None):
        super().__init__(known or {})
        self.start, self.new = 0, []

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = self.start + len(self.new)
        self.new.append(chunk)
        return number

    def of(self, chunks: list[str], start: int) -> np.ndarray:
        """The numbers of ``chunks``; new ones count from ``start``."""
        self.start, self.new = start, []
        return np.fromiter(map(self.__getitem__, chunks), dtype=np.int64, count=len(chunks))


def token_sizes(tokenizer) -> np.ndarray:
    """Bytes of each id of a byte-level vocabulary: a letter of a token stands for a byte, and added
    tokens are spelled as they are."""
    added = tokenizer.get_added_tokens_decoder()
    return np.array([len(added[k].content.encode()) if k in added else len(tokenizer.id_to_token(k) or "") for k in range(tokenizer.get_vocab_size())], dtype=np.int64)


def ids_after_cuts(tokenizer, sizes: np.ndarray, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a space and each chunk, one after the other, and how many each chunk has.

    Chunks without white space at their ends are encoded together, with a space between them, and told
    apart by the bytes of their ids; the others by themselves."""
    counts = np.zeros(len(chunks), dtype=np.int64)
    plain = [k for k, c in enumerate(chunks) if c and c == c.strip()]
    ids = np.zeros(0, dtype=np.int64)
    if plain:
        groups = [plain[at : at + TOGETHER] for at in range(0, len(plain), TOGETHER)]
        found = tokenizer.encode_batch_fast([" " + " ".join([chunks[k] for k in g]) for g in groups], add_special_tokens=False)
        ids = np.array([x for e in found for x in e.ids], dtype=np.int64)
        after = np.cumsum(sizes[ids])
        ends = np.cumsum([len(chunks[k].encode("utf-8", "replace")) + 1 for k in plain])
        stops = np.searchsorted(after, ends)
        if len(after) <= stops[-1] or (after[stops] != ends).any():
            plain, ids = [], ids[:0]  # a token across a cut: the vocabulary isn't what it seems
        else:
            counts[plain] = np.diff(stops + 1, prepend=0)
    apart = np.ones(len(chunks), dtype=bool)
    apart[plain] = False
    rest = np.flatnonzero(apart)
    if not len(rest):
        return ids, counts
    single = [np.array(e.ids, dtype=np.int64) for e in tokenizer.encode_batch_fast([" " + chunks[k] for k in rest], add_special_tokens=False)]
    counts[rest] = [len(x) for x in single]
    out = np.empty(int(counts.sum()), dtype=np.int64)
    owner = np.repeat(apart, counts)
    out[owner], out[~owner] = np.concatenate(single), ids
    return out, counts
