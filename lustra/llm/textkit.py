"""Vectorised hashing of bytes, words and word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX1, _MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over 64 output bits; a bijection."""
    h = (h ^ (h >> _U(30))) * _MIX1
    h = (h ^ (h >> _U(27))) * _MIX2
    return h ^ (h >> _U(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64))
FOLDED = BYTE.copy()
FOLDED[65:91] = BYTE[97:123]
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept up to 4 Mi entries."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= 1 << 22:
            _powers[base] = have
    return have[:n]


class Rolling:
    """Polynomial prefix sums over a sequence of 64-bit symbols: the hash of any slice in O(1)."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.n = n
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(symbols * _power(_BASE, n), out=self.prefix[1:])
        self.inverse = _power(_INVERSE, n + 1)

    def windows(self, k: int) -> np.ndarray:
        """Hash of each slice of length k, by its start."""
        if self.n < k:
            return np.zeros(0, dtype=np.uint64)
        return mix((self.prefix[k:] - self.prefix[:-k]) * self.inverse[: self.n - k + 1])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + end.astype(np.uint64) - start.astype(np.uint64))


def sliding(a: np.ndarray, width: int, op) -> np.ndarray:
    """op (minimum or maximum) of each run of ``width`` neighbours, in log2(width) passes."""
    done = 1
    while done * 2 <= width:
        a = op(a[:-done], a[done:])
        done *= 2
    rest = width - done
    return op(a[:-rest], a[rest:]) if rest else a


def _edges(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    inside = np.zeros(len(x) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[x]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _place_value(key: np.ndarray) -> np.ndarray:
    return mix((key.astype(np.uint64) + _U(1)) * _U(_BASE))


_NEAR = _place_value(np.arange(64 * 256))
_LOWER = np.arange(256)
_LOWER[65:91] = np.arange(97, 123)


def _hashed(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word of an array of bytes, A-Z lowered: the sum of values drawn for each byte at
    its place in the word.  Unlike a polynomial modulo 2**64, no words are equal by construction."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    key = (np.arange(int(size.sum())) - np.repeat(first, size)) << 8 | _LOWER[x[~SPACE[x]]]
    if int(size.max()) <= 64:
        value = _NEAR[key]
    else:
        value, near = np.empty(len(key), dtype=np.uint64), key < len(_NEAR)
        value[near], value[~near] = _NEAR[key[near]], _place_value(key[~near])
    return mix(np.add.reduceat(value, first))


def words(data: bytes) -> np.ndarray:
    """Hash of each word ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, in order."""
    x = np.frombuffer(data, dtype=np.uint8)
    return _hashed(x, *_edges(x))


def shingles(word: np.ndarray, width: int = 5) -> np.ndarray:
    """Hash of each run of ``width`` words; of the whole sequence if there are fewer (none: empty)."""
    n = len(word)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    if n < width:
        return mix(shingles(word, n) + _U(n))
    h = np.zeros(n - width + 1, dtype=np.uint64)
    for j in range(width):
        h = h * _U(_BASE) + word[j : n - width + 1 + j]
    return mix(h)


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    new = np.ones(len(h), dtype=bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def shingle_set(data: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return _distinct(shingles(words(data), width))


def shingle_sets(texts: list[bytes], width: int = 5, chunk: int = 1 << 16) -> Iterator[np.ndarray]:
    """:func:`shingle_set` of each text; neighbouring texts of ``chunk`` bytes together are hashed
    in one pass."""
    at = 0
    while at < len(texts):
        stop, size = at + 1, len(texts[at])
        while stop < len(texts) and size + len(texts[stop]) < chunk:
            size += len(texts[stop]) + 1
            stop += 1
        x = np.frombuffer(b" ".join(texts[at:stop]), dtype=np.uint8)
        start, end = _edges(x)
        word = _hashed(x, start, end)
        every = shingles(word, width) if len(word) >= width else word
        bound = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts[at:stop]])).tolist()
        first = 0
        for last in bound:
            yield _distinct(every[first : last - width + 1] if last - first >= width else shingles(word[first:last], width))
            first = last
        at = stop
