"""Word hashes, shingle sets and MinHash minima, vectorised over a batch of texts.

Words are runs of bytes other than space and ``\\x09``-``\\x0D`` after A-Z became
a-z. A shingle is ``SIZE`` consecutive words, or all words of a text with
fewer. A set is its sorted distinct 64-bit hashes.

A word is hashed by a chain of mixing steps over its eight-byte parts, and a
sequence of words by a polynomial modulo the prime 2^61 - 1: unlike one modulo a
power of two it tells every pair of short sequences apart but by chance, however
regular they are.
"""

from __future__ import annotations

import hashlib

import numpy as np

SIZE = 5
_RNG = np.random.default_rng(20_240_501)
P = np.uint64(2**61 - 1)
BYTE = _RNG.integers(1, 2**61 - 1, 256, dtype=np.int64).astype(np.uint64)
_BASE = 0x1E3779B97F4A7C15 % (2**61 - 1)
_STEP = [np.uint64(x | 1) for x in _RNG.integers(1, 2**63, SIZE, dtype=np.int64)]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_LOW32, _LOW29 = np.uint64(2**32 - 1), np.uint64(2**29 - 1)


def fold(x: np.ndarray) -> np.ndarray:
    """Any 64-bit numbers modulo P."""
    x = (x & P) + (x >> np.uint64(61))
    return np.where(x >= P, x - P, x)


def _times(a, b):
    a0, a1, b0, b1 = a & _LOW32, a >> np.uint64(32), b & _LOW32, b >> np.uint64(32)
    middle, low = a1 * b0 + a0 * b1, a0 * b0
    return fold(a1 * b1 * np.uint64(8) + (middle >> np.uint64(29)) + ((middle & _LOW29) << np.uint64(32)) + (low & P) + (low >> np.uint64(61)))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo P, both below P; in blocks that stay in the cache."""
    if len(a) <= 32_768:
        return _times(a, b)
    out = np.empty(len(a), np.uint64)
    for i in range(0, len(a), 32_768):
        out[i : i + 32_768] = _times(a[i : i + 32_768], b[i : i + 32_768] if np.ndim(b) else b)
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base modulo P, and of its inverse."""
    if len(_powers[0]) <= n:
        for i, b in enumerate((_BASE, pow(_BASE, -1, int(P)))):
            x = _powers[i]
            while len(x) <= n:
                x = np.concatenate((x, times(x, np.uint64(pow(b, len(x), int(P))))))
            _powers[i] = x
    return _powers[0], _powers[1]


def prefix(x: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Running sums of x (below P) times powers, of the place or as ``at`` says; see :func:`span`."""
    ahead = powers(len(x))[0]
    terms = times(x, ahead[: len(x)] if at is None else ahead[at])
    h = np.zeros(len(x) + 1, np.uint64)
    high = fold(np.cumsum(terms >> np.uint64(32), dtype=np.uint64))
    h[1:] = fold(fold(np.cumsum(terms & _LOW32, dtype=np.uint64)) + (high >> np.uint64(29)) + ((high & _LOW29) << np.uint64(32)))
    return h


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return fold(a + (P - b))


def span(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the items a to b that doesn't depend on where they lie."""
    return times(minus(h[b], h[a]), powers(len(h))[1][a])


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_PARTS = 8


def edges(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The byte each word begins at, and the one after its last."""
    b = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero(np.diff(np.concatenate(([0], (~_SPACE[b]).view(np.int8), [0]))))
    return at[::2], at[1::2]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of lower-cased raw, and the byte it begins at."""
    first, last = edges(raw)
    size = last - first
    parts = np.ndarray(len(raw) + 1, "<u8", raw + bytes(8), strides=(1,))
    h = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    todo = np.arange(len(first))
    for k in range(0, 8 * _PARTS, 8):
        if not len(todo):
            break
        h[todo] = mix(h[todo] ^ (parts[first[todo] + k] & _MASK[np.minimum(size[todo] - k, 8)]))
        todo = todo[size[todo] > k + 8]
    for i in todo.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[first[i] : last[i]], digest_size=8).digest(), "little")
    return h, first


def all_shingles(words: np.ndarray) -> np.ndarray:
    """The hash of the ``SIZE`` words from each word on; of the last words, 0."""
    out = np.zeros(len(words), np.uint64)
    n = len(words) - SIZE + 1
    if n > 0:
        total = np.full(n, np.uint64(SIZE), np.uint64)
        for i in range(SIZE):
            total += words[i : n + i] * _STEP[i]
        out[:n] = mix(total)
    return out


def shingles(words: np.ndarray) -> np.ndarray:
    """The sorted distinct shingles of a sequence of word hashes."""
    if not len(words):
        return words
    n = min(SIZE, len(words))
    total = np.full(len(words) - n + 1, np.uint64(n), np.uint64)
    for i in range(n):
        total += words[i : len(words) - n + 1 + i] * _STEP[i]
    return np.unique(mix(total))


def signatures(minima: np.ndarray) -> tuple[list[bytes], list[list[int]]]:
    """Of each row of minima: a byte of each, and a bit of each packed in 64-bit numbers."""
    taken = (minima >> np.uint64(32)).astype(np.uint8)
    bits = np.packbits((taken & 1).astype(np.uint8), axis=1)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))
    return [x.tobytes() for x in taken], np.ascontiguousarray(bits).view("<i8").tolist()


class MinHash:
    """``bands * rows`` universal hash functions; band values are 64-bit hashes of ``rows`` minima."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(bands * 1000 + rows)
        k = bands * rows
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 2**63, k, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, k, dtype=np.int64).astype(np.uint64)
        self.mixers = rng.integers(0, 2**63, rows, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def minima(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of minima for each set; sets aren't empty."""
        out = np.empty((len(sets), len(self.a)), np.uint64)
        at = 0
        while at < len(sets):
            size, end = len(sets[at]), at + 1
            while end < len(sets) and size + len(sets[end]) <= 4096:
                size, end = size + len(sets[end]), end + 1
            if size > 4096:  # one long text
                least = np.full(len(self.a), np.uint64(2**64 - 1))
                for i in range(0, size, 1024):
                    np.minimum(least, (sets[at][i : i + 1024, None] * self.a + self.b).min(0), out=least)
                out[at] = least
            else:
                starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[at : end - 1]]))).astype(np.int64)
                out[at:end] = np.minimum.reduceat(np.concatenate(sets[at:end])[:, None] * self.a + self.b, starts, axis=0)
            at = end
        return out

    def band_values(self, minima: np.ndarray) -> np.ndarray:
        parts = mix(minima).reshape(len(minima), self.bands, self.rows) * self.mixers
        return mix(parts.sum(2, dtype=np.uint64) + np.arange(1, self.bands + 1, dtype=np.uint64)).view(np.int64)
