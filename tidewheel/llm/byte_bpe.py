"""Byte-level BPE encoding and decoding by ranks, in two tiers.

Texts are split into pre-tokens by a pattern. A minimal perfect hash of the
vocabulary takes all distinct pre-tokens of a slice of texts at once: those
that are tokens themselves are resolved by it, after their bytes have been
compared. The misses are merged from single bytes: the bytes are a linked list,
a heap has the ranks of the neighbouring pairs, and the pair of least rank, the
leftmost of equal ones, is merged until no pair is a token. Merged misses are
remembered, up to ``MERGED_HELD`` of them.

The pattern never carries a match over a space that stands between two
characters which aren't white space, so a text is first cut there and the
pattern is applied once to each distinct stretch of a slice. That holds for
patterns whose matches hold a space only in front or among white space alone;
``encode`` checks the pattern on samples and applies it to whole texts
where it doesn't hold.

Everything is one narrow pass: nothing is shuffled, and a task holds one slice
of texts, or one text (long ones are taken in stretches).

Defined cases: a null text is encoded as the empty text: no ids, empty bytes;
repeated rows get equal results; an empty table gives an empty table; columns
of the table stay, and where it has one named like ``out``, ``out`` gets
underscores behind it.
"""

from __future__ import annotations

import base64
import heapq
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.common import fresh

#: Characters of texts that are encoded together, and merged pre-tokens that are remembered.
SLICE_CHARS, MERGED_HELD = 4_000_000, 500_000

RESULT = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.BinaryType())])

_MIX, _STEP, _BASE = np.uint64(0x9E3779B97F4A7C15), 0xD1B54A32D192ED03, 0x5851F42D4C957F2D
#: A space between two characters that aren't white space.
_GAP = re.compile(r" (?<=\S )(?=\S)")
#: Texts with a space that isn't such a gap.
_ODD = re.compile(r" \s|\s |^ | \Z")
_SAMPLES = ("ab", "don't", "x1", "!?", "'s", "é̂", "日本", "7.5", "\U0001f600", "\x1c", "'")


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt * _STEP % (1 << 64))) * _MIX
    return h ^ (h >> np.uint64(32))


class MinimalPerfectHash:
    """Numbers distinct 64-bit keys from 0 without gaps.

    On each level a key takes the place it hashes to, if no other key does; the
    others go on to the next level. A key's number is the count of places taken
    before its own. Foreign keys get some number, or -1.
    """

    def __init__(self, keys: np.ndarray, room: float = 1.5):
        self.levels, first = [], 0
        while len(keys):
            size = max(64, int(room * len(keys)))
            at = _mixed(keys, len(self.levels) + 1) % np.uint64(size)
            taken = np.bincount(at.astype(np.int64), minlength=size) == 1
            self.levels.append((size, taken, (first + np.cumsum(taken) - taken).astype(np.int32)))
            first += int(taken.sum())
            keys = keys[~taken[at]]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        number, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, taken, before) in enumerate(self.levels):
            at = _mixed(keys[left], level + 1) % np.uint64(size)
            found = taken[at]
            number[left[found]] = before[at[found]]
            left = left[~found]
        return number


def _flat(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the stretches of these sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` one after another."""
    return values[np.repeat(starts, sizes) + _flat(sizes)]


class Vocabulary:
    """Tokens by rank: found by the minimal perfect hash, and their bytes by id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        tokens = list(ranks)
        sizes = np.array([len(t) for t in tokens], np.int64)
        self.longest = int(sizes.max(initial=0))
        self.powers = np.array([pow(_BASE, k, 1 << 64) for k in range(self.longest)], np.uint64)
        data = np.frombuffer(b"".join(tokens), np.uint8)
        starts = np.cumsum(sizes) - sizes
        keys = self._keys(data, starts, sizes)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two tokens have one 64-bit key")
        self.number = MinimalPerfectHash(keys)
        order = np.argsort(self.number(keys))  # tokens lie in the order of their numbers
        self.ids, self.sizes = np.array(list(ranks.values()), np.int64)[order], sizes[order]
        self.bytes = gather(data, starts[order], self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.number_of_id = np.full(int(self.ids.max(initial=-1)) + 1, -1, np.int64)
        self.number_of_id[self.ids] = np.arange(len(order))

    def _keys(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if not len(sizes):
            return np.empty(0, np.uint64)
        terms = (gather(data, starts, sizes).astype(np.uint64) + np.uint64(1)) * self.powers[_flat(sizes)]
        return np.add.reduceat(terms, np.cumsum(sizes) - sizes)

    def find(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids of strings that are tokens, -1 for others. No string is empty."""
        out = np.full(len(sizes), -1, np.int64)
        short = np.flatnonzero(sizes <= self.longest)
        number = self.number(self._keys(data, starts[short], sizes[short]))
        fits = (number >= 0) & (self.sizes[number] == sizes[short])
        short, number = short[fits], number[fits]
        if len(short):
            n = sizes[short]
            differs = gather(data, starts[short], n) != gather(self.bytes, self.starts[number], n)
            same = ~np.logical_or.reduceat(differs, np.cumsum(n) - n)
            out[short[same]] = self.ids[number[same]]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        number = self.number_of_id[ids]
        return gather(self.bytes, self.starts[number], self.sizes[number]).tobytes()


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a string of bytes, by a heap over its linked bytes."""
    n, get = len(piece), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    # of the pair that begins at i: its rank times n, plus i; -1 if it is no token
    key = [r * n + i if (r := get(piece[i : i + 2], -1)) >= 0 else -1 for i in range(n - 1)]
    heap = [k for k in key if k >= 0]
    key.append(-1)
    heapq.heapify(heap)
    while heap:
        k = heapq.heappop(heap)
        i = k % n
        if key[i] != k:
            continue
        gone = after[i]
        end = after[i] = after[gone]
        key[gone] = -1
        if end < n:
            before[end] = i
            if (r := get(piece[i : after[end]], -1)) >= 0:
                key[i] = r * n + i
                heapq.heappush(heap, key[i])
            else:
                key[i] = -1
        else:
            key[i] = -1
        if i:
            p = before[i]
            if (r := get(piece[p:end], -1)) >= 0:
                key[p] = r * n + p
                heapq.heappush(heap, key[p])
            else:
                key[p] = -1
    ids, i = [], 0
    while i < n:
        end = after[i]
        ids.append(ranks[piece[i:end]])
        i = end
    return ids


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One for each Python worker, so that tasks share what it remembers."""
    return Codec(load(path), pattern)


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """A file of lines ``base64 of the token, space, rank``; every single byte must be a token."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path}: not every byte is a token")
    return Vocabulary(ranks)


def breaks_at_gaps(pattern) -> bool:
    """Whether matches before a gap and from a gap on are those of the whole text."""
    return all(pattern.findall(f"{a} {b}") == pattern.findall(a) + pattern.findall(f" {b}") for a in _SAMPLES for b in _SAMPLES)


def _distinct(strings: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct strings and each one's number among them."""
    coded = strings.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64)


class Codec:
    """Encodes texts; remembers what it has merged."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.cuts = breaks_at_gaps(self.pattern)
        self.recent: dict[bytes, list[int]] = {}
        self.older: dict[bytes, list[int]] = {}

    def _merged(self, piece: bytes) -> list[int]:
        ids = self.recent.get(piece)
        if ids is None:
            ids = self.older.get(piece)
            ids = merge(piece, self.vocabulary.ranks) if ids is None else ids
            if len(piece) <= 64:
                self.recent[piece] = ids
        return ids

    def _found(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens: values, and each one's first and its number of values."""
        if not len(pieces):
            return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        ends = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        data = np.frombuffer(pieces.buffers()[2], np.uint8)
        starts, sizes = ends[:-1], np.diff(ends)
        ids = self.vocabulary.find(data, starts, sizes)
        missed = np.flatnonzero(ids < 0)
        if len(self.recent) > MERGED_HELD:  # what comes again is found among the older ones
            self.recent, self.older = {}, self.recent
        raw = data.tobytes()
        merged = [self._merged(raw[a:b]) for a, b in zip(starts[missed].tolist(), ends[1:][missed].tolist(), strict=True)]
        counts = np.ones(len(ids), np.int64)
        counts[missed] = np.fromiter(map(len, merged), np.int64, len(merged))
        first = np.cumsum(counts) - counts
        values = np.empty(int(counts.sum()), np.int32)
        hit = ids >= 0
        values[first[hit]] = ids[hit]
        n = counts[missed]
        values[np.repeat(first[missed], n) + _flat(n)] = np.fromiter(chain.from_iterable(merged), np.int32, int(n.sum()))
        return values, first, counts

    def _stretches(self, stretches: list[str], joined: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of stretches: values, and each stretch's first and its number of values. ``joined``: they may stand side by side."""
        if joined:
            found = self.pattern.findall("".join(stretches))
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
            held = np.diff(np.searchsorted(ends, np.cumsum(np.fromiter(map(len, stretches), np.int64, len(stretches))), "right"), prepend=0)
        else:
            each = [self.pattern.findall(s) for s in stretches]
            held = np.fromiter(map(len, each), np.int64, len(each))
            found = list(chain.from_iterable(each))
        distinct, number = _distinct(pa.array(found, pa.large_string()))
        values, first, counts = self._found(distinct)
        values, counts = gather(values, first[number], counts[number]), counts[number]
        total, last = np.concatenate(([0], np.cumsum(counts))), np.cumsum(held)
        return values, total[last - held], total[last] - total[last - held]

    def code(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        if not self.cuts:
            values, _, counts = self._stretches(texts, False)
            return values, counts
        odd = np.array([bool(_ODD.search(t)) for t in texts], bool)
        plain = pc.split_pattern(pa.array([t for t, x in zip(texts, odd, strict=True) if not x], pa.large_string()), " ")
        others = [_GAP.split(t) for t, x in zip(texts, odd, strict=True) if x]
        order = np.argsort(odd, kind="stable")  # texts are taken in this order
        held = np.concatenate((np.diff(plain.offsets.to_numpy()), np.array([len(s) for s in others], np.int64))).astype(np.int64)
        strings = pa.concat_arrays([plain.flatten(), pa.array(chain.from_iterable(others), pa.large_string())])
        at = np.cumsum(held) - held
        heads = np.zeros(len(strings), bool)  # a text's first stretch has no space in front
        heads[at] = True
        head, head_number = _distinct(strings.filter(pa.array(heads)))
        rest, rest_number = _distinct(strings.filter(pa.array(~heads)))
        values, first, counts = self._stretches(head.to_pylist(), False)
        more, more_first, more_counts = self._stretches([" " + x for x in rest.to_pylist()], True)
        values = np.concatenate((values, more))
        first, counts = np.concatenate((first, more_first + len(values) - len(more))), np.concatenate((counts, more_counts))
        stretch = np.empty(len(strings), np.int64)
        stretch[heads], stretch[~heads] = head_number, rest_number + len(head)
        ids, n = gather(values, first[stretch], counts[stretch]), counts[stretch]
        n = np.add.reduceat(n, at) if len(at) else n
        back = np.argsort(order)
        return gather(ids, (np.cumsum(n) - n)[back], n[back]), n[back]

    def code_long(self, text: str) -> np.ndarray:
        """One text of any length, in stretches that begin at gaps."""
        ids, at = [], 0
        while self.cuts and len(text) - at > SLICE_CHARS and (gap := _GAP.search(text, at + SLICE_CHARS)):
            ids.append(self.code([text[at : gap.start()]])[0])
            at = gap.start()
        return np.concatenate([*ids, self.code([text[at:]])[0]])


def encode(docs: DataFrame, path: str, pattern: str, *, text_col: str = "text", out: str = "byte_bpe") -> DataFrame:
    """``docs`` with a struct column ``out``: ids and the bytes that they decode to."""
    out = fresh(docs, out)
    kind = pa.struct([pa.field("ids", pa.list_(pa.field("element", pa.int32(), False))), pa.field("decoded", pa.binary())])

    def run(batches):
        coder = codec(path, pattern)
        for batch in batches:
            texts, at = [t or "" for t in batch.column(text_col).to_pylist()], 0
            while at < len(texts):
                size, end = len(texts[at]), at + 1
                while end < len(texts) and size + len(texts[end]) <= SLICE_CHARS:
                    size, end = size + len(texts[end]), end + 1
                if end == at + 1:
                    ids = coder.code_long(texts[at])
                    counts = np.array([len(ids)])
                else:
                    ids, counts = coder.code(texts[at:end])
                ends = np.concatenate(([0], np.cumsum(counts)))
                decoded = [coder.vocabulary.decode(ids[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()), type=kind.field("ids").type)
                yield pa.RecordBatch.from_arrays([*(c.slice(at, end - at) for c in batch.columns), pa.StructArray.from_arrays([lists, pa.array(decoded, pa.binary())], fields=list(kind))], [*batch.schema.names, out])
                at = end

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, RESULT)]))


def decode(table: DataFrame, path: str, *, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``table`` with a binary column ``out``: the bytes of a column of ids; null ids give null."""
    out = fresh(table, out)

    def run(batches):
        vocabulary = load(path)
        for batch in batches:
            ids = batch.column(ids_col)
            decoded = [None if x is None else vocabulary.decode(np.array(x, np.int64)) for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], [*batch.schema.names, out])

    return table.mapInArrow(run, T.StructType([*table.schema.fields, T.StructField(out, T.BinaryType())]))


def report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: the digest columns of :func:`encode`."""
    coded = encode(docs.select("doc_id", "text"), path, pattern, out="r")
    return coded.select(
        "doc_id",
        F.size("r.ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("r.ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("r.decoded", 256).alias("decoded_sha256"),
    )
