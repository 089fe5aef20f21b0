"""Periodic runs of words, by recompression.

A run is a stretch of consecutive words with smallest period q and a length of
at least ``max(min_length, 2 * q)`` that no neighbouring word extends keeping
the period. Within a run's first part, windows of half ``min_length`` words equal those
q words later, so every run holds a point of a grid whose step for a period p
grows with p (a harmonic number of points in all): where the windows at a point
and p words later agree, the run may lie. Each such candidate is extended
exactly to both sides by longest-common-extension queries on a run-length
grammar, and counts if it is long enough.

The grammar (``Grammar``) comes from recompression: blocks of one symbol become
one symbol, then pairs from a left and a right half of the alphabet become one,
alternating, until little is left. Both steps look at neighbours only, so equal
stretches are parsed alike but for their ends, and a query climbs and descends
with a few comparisons a level. Queries to the left go to the grammar of the
reversed words. No suffix array, and no word-by-word extension.

Documents of a slice are taken together, a mark of its own behind each; the
grammar is built for those with candidates only. Everything is one narrow pass:
nothing is shuffled, and a task holds one slice of documents, or one document.

Defined cases: a null text has no words; white space is ASCII's (space and
U+0009 to U+000D); repeated rows get equal results; an empty table gives an
empty table; columns of the table stay, and where it has one named like
``out``, ``out`` gets underscores behind it. Among runs of one greatest length
the first begins earliest, then has the smallest period. A null doc_id leaves
the words of ``report`` as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.common import fresh

#: Least words of a run, and bytes of texts that are taken together.
MIN_LENGTH, SLICE_BYTES = 12, 2_000_000

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])


class Grammar:
    """Levels of a run-length grammar: each level's symbols and where they begin; the last entry is the end."""

    def __init__(self, symbols: np.ndarray):
        starts, names = np.arange(len(symbols) + 1), int(symbols.max(initial=0)) + 1
        self.levels, self.blocked = [(symbols, starts)], set()  # blocked: levels above which blocks stand
        stuck = 0
        while len(symbols) > 1 and stuck < 8:
            before = len(symbols)
            for step in (self._blocks, self._pairs):
                symbols, starts, names, changed = step(symbols, starts, names)
                if changed:
                    self.blocked |= {len(self.levels) - 1} if step == self._blocks else set()
                    self.levels.append((symbols, starts))
            stuck = stuck + 1 if len(symbols) > 0.97 * before else 0

    @staticmethod
    def _blocks(symbols, starts, names):
        first = np.concatenate(([0], np.flatnonzero(symbols[1:] != symbols[:-1]) + 1))
        if len(first) == len(symbols):
            return symbols, starts, names, False
        sizes = np.diff(np.append(first, len(symbols)))
        blocks, out = sizes > 1, symbols[first]
        kinds, number = np.unique(out[blocks] * (len(symbols) + 1) + sizes[blocks], return_inverse=True)
        out[blocks] = names + number
        return out, starts[np.append(first, len(symbols))], names + len(kinds), True

    def _pairs(self, symbols, starts, names):
        # halves of the alphabet by a bit of each symbol's mixed number, another one on each level
        mixed = (symbols.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (len(self.levels) + 1) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        half = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(63) != 0
        up, down = half[:-1] & ~half[1:], ~half[:-1] & half[1:]
        at = np.flatnonzero(up if up.sum() >= down.sum() else down)  # never two that overlap
        if not len(at):
            return symbols, starts, names, False
        kinds, number = np.unique(symbols[at] * names + symbols[at + 1], return_inverse=True)
        out = symbols.copy()
        out[at] = names + number
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        return out[stay], starts[np.append(stay, True)], names + len(kinds), True

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How far the symbols from x on agree with those from y on, for x < y; the last symbol must stand nowhere else."""
        begun, x, y = x, x.copy(), y.copy()
        met = np.zeros(len(x), np.int64)  # the level on which a difference was met
        climbing = np.arange(len(x))
        for level in range(len(self.levels)):
            here, climbed = climbing, [climbing[:0]]
            while len(here):
                here, differ, i = self._compare(level, here, x, y)
                met[differ] = level
                if level + 1 == len(self.levels):
                    self._pass(level, here, i, x, y)
                    continue
                starts = self.levels[level + 1][1]
                both = (starts[np.searchsorted(starts, x[here])] == x[here]) & (starts[np.searchsorted(starts, y[here])] == y[here])
                climbed.append(here[both])
                here = here[~both]
                self._pass(level, here, i[~both], x, y)
            climbing = np.concatenate(climbed)
        for level in reversed(range(len(self.levels) - 1)):
            here = np.flatnonzero(met > level)
            while len(here):
                here, _, i = self._compare(level, here, x, y)
                self._pass(level, here, i, x, y)
        return x - begun

    def _compare(self, level, here, x, y):
        """Those whose symbols are equal, those whose symbols differ, and the number of the former's symbol at x."""
        symbols, starts = self.levels[level]
        i = np.searchsorted(starts, x[here])
        same = symbols[i] == symbols[np.searchsorted(starts, y[here])]
        return here[same], here[~same], i[same]

    def _pass(self, level, here, i, x, y):
        """Moves both sides over one symbol, or over what both have left of their blocks of it."""
        starts = self.levels[level][1]
        step = starts[i + 1] - starts[i]
        if level in self.blocked:
            blocks = self.levels[level + 1][1]
            left = [blocks[np.searchsorted(blocks, z[here], "right")] - z[here] for z in (x, y)]
            step = np.minimum(*left)
        x[here] += step
        y[here] += step


def _windows(symbols: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit key of the symbols from each place on; equal windows have equal keys."""
    held, keys = symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.zeros(len(symbols), np.uint64)
    for k in range(size):
        keys = keys * np.uint64(0x5851F42D4C957F2D)
        keys[: len(keys) - k] += held[k:]
    return keys ^ (keys >> np.uint64(31))


def candidates(symbols: np.ndarray, sizes: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid points at which a run may lie: period, place, step of the grid. ``sizes``: of the documents, descending; each ends with a mark of its own."""
    window = (min_length + 1) // 2
    keys, ends = _windows(symbols, window), np.cumsum(sizes + 1)
    found = []
    longest = int(sizes[0]) if len(sizes) else 0
    # only the documents that are long enough for a period take part
    counts = np.searchsorted(-sizes, -np.maximum(min_length, 2 * np.arange(longest // 2 + 1)), "right")
    for p in range(1, longest // 2 + 1):
        if not counts[p]:
            break
        end, step = int(ends[counts[p] - 1]), max(p, min_length - p) - window + 1
        hits = np.flatnonzero(keys[: end - p : step] == keys[p:end:step])
        if len(hits):
            found.append((np.full(len(hits), p), hits * step, np.full(len(hits), step)))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3


def _extended(symbols: np.ndarray, periods, places, steps, min_length: int):
    """The runs (start, length, period) that hold candidates. The symbols begin and end with marks."""
    ahead, behind, n = Grammar(symbols), Grammar(symbols[::-1].copy()), len(symbols)
    runs = []
    while len(places):
        # of neighbouring grid points one is asked; what its run covers needs no question
        new = np.concatenate(([True], (periods[1:] != periods[:-1]) | (places[1:] - places[:-1] != steps[1:])))
        p, at = periods[new], places[new]
        more, less = ahead.common(at, at + p), behind.common(n - at - p, n - at)
        runs.append((at - less, less + p + more, p))
        covered = places < (at + np.maximum(more, 1))[np.cumsum(new) - 1]
        periods, places, steps = periods[~covered], places[~covered], steps[~covered]
    start, length, period = (np.concatenate(c) for c in zip(*runs, strict=True))
    keep = length >= np.maximum(min_length, 2 * period)
    start, length, period = start[keep], length[keep], period[keep]
    order = np.lexsort((period, length, start))  # multiples of a run's period give the same stretch
    start, length, period = start[order], length[order], period[order]
    first = np.concatenate(([True], (start[1:] != start[:-1]) | (length[1:] != length[:-1]))) if len(start) else np.empty(0, bool)
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def find(documents: list[np.ndarray], min_length: int = MIN_LENGTH) -> list[np.ndarray]:
    """The runs of each sequence of numbers from 0: rows of start, length, period, by start and period."""
    none = np.empty((0, 3), np.int64)
    out = [none] * len(documents)
    sizes = np.array([len(d) for d in documents], np.int64)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] >= min_length]
    if not len(order):
        return out
    names = 1 + max(int(documents[k].max()) for k in order)
    symbols = np.concatenate([x for n, k in enumerate(order) for x in (documents[k], [names + n])]).astype(np.int64)
    begins = np.cumsum(sizes[order] + 1) - sizes[order] - 1
    periods, places, steps = candidates(symbols, sizes[order], min_length)
    within = np.searchsorted(begins, places, "right") == np.searchsorted(begins, places + periods, "right")
    periods, places, steps = periods[within], places[within], steps[within]
    if not len(places):
        return out
    # the grammar has the documents with candidates only, and a mark in front
    owner = np.searchsorted(begins, places, "right") - 1
    held = np.unique(owner)
    some = np.concatenate([[names + len(order)], *(symbols[begins[k] : begins[k] + sizes[order[k]] + 1] for k in held)])
    moved = np.cumsum(sizes[order[held]] + 1) - sizes[order[held]]
    start, length, period = _extended(some, periods, places - begins[owner] + moved[np.searchsorted(held, owner)], steps, min_length)
    whose = np.searchsorted(moved, start, "right") - 1
    cuts = np.searchsorted(whose, np.arange(len(held) + 1))
    for k, a, b in zip(held, cuts[:-1], cuts[1:], strict=True):
        out[order[k]] = np.column_stack((start[a:b], length[a:b], period[a:b])) - [moved[np.searchsorted(held, k)], 0, 0]
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of n words stays: those of runs go, but for each run's first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def find_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", out: str = "runs", min_length: int = MIN_LENGTH, pick: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, the runs by start and period, and the text without repetitions.

    ``pick(id, n)`` may give the numbers of the words that take the places of a
    document's n words. ``min_length``: 4 words at least.
    """
    if min_length < 4:
        raise ValueError("min_length must be 4 or more")
    out = fresh(docs, out)
    run_kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    kind = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.field("element", run_kind))), ("collapsed", pa.string())])

    def rows(ids: list, texts: list[bytes]) -> pa.Array:
        words = [t.split() for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        numbers = pa.array([x for w in words for x in w], pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
        each = np.split(numbers, ends[:-1])
        for k, (i, w) in enumerate(zip(ids, words, strict=True)):
            if pick is not None and w and (at := pick(i, len(w))) is not None:
                each[k], words[k] = each[k][at], [w[x] for x in at.tolist()]
        found = find(each, min_length)
        collapsed = [b" ".join(w if not len(r) else [x for x, stays in zip(w, kept_words(len(w), r).tolist(), strict=True) if stays]) for w, r in zip(words, found, strict=True)]
        flat = np.concatenate(found)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(r) for r in found]))), pa.int32()), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in range(3)], fields=list(run_kind)), type=kind.field("runs").type)
        return pa.StructArray.from_arrays([pa.array(sizes), lists, pa.array([c.decode() for c in collapsed], pa.string())], fields=list(kind))

    def run(batches):
        for batch in batches:
            texts, ids, at = [(t or "").encode() for t in batch.column(text_col).to_pylist()], batch.column(id_col).to_pylist(), 0
            while at < len(texts):
                size, end = len(texts[at]), at + 1
                while end < len(texts) and size + len(texts[end]) <= SLICE_BYTES:
                    size, end = size + len(texts[end]), end + 1
                yield pa.RecordBatch.from_arrays([*(c.slice(at, end - at) for c in batch.columns), rows(ids[at:end], texts[at:end])], [*batch.schema.names, out])
                at = end

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, RESULT)]))


def rearranged(doc_id: int | None, n: int) -> np.ndarray | None:
    """The word numbers of a tenth of the documents, chosen by id, that repeat a stretch from some word on to the end."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: number and digest of the runs, the longest one, and the digest of the collapsed text."""
    found = find_runs(docs.select("doc_id", "text"), out="r", pick=rearranged)
    longest = F.array_max(F.transform("r.runs", lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    lines = F.transform("r.runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"]))
    found = found.select("doc_id", F.size("r.runs").cast("long").alias("n_runs"), longest.alias("x"), F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))).alias("lines"), "r.collapsed")
    return found.select(
        "doc_id",
        "n_runs",
        (-F.col("x.start")).alias("start"),
        F.col("x.length").alias("length"),
        (-F.col("x.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("x.length") / -F.col("x.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
