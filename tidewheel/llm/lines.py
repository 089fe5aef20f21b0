"""Texts of a batch by their words and lines: hashes, first occurrences, and texts with some lines taken out.

A line is what stands between two ``\n``. A text is known by its xxhash64 and
a place by (doc_id, text, line number); places are ordered so, nulls first.
Rows alike in id and text share their places, and so their fate.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.common import fresh
from tidewheel.llm.shingles import SIZE, all_shingles, fold, mix, prefix, shingles, span, word_hashes

#: Characters of the texts that are hashed together, about; a longer text is hashed by itself.
SLICE = 1 << 20


class Texts:
    """Word hashes of several texts one after the other, and where texts and lines begin among them."""

    def __init__(self, texts: list[str | None]):
        raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        raw = b"\n".join(raws).lower()
        begins = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raws])[:-1])).astype(np.int64) if raws else np.empty(0, np.int64)
        self.words, at = word_hashes(raw)
        breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
        #: The first word of each text and line, and the end.
        self.firsts = np.concatenate((np.searchsorted(at, begins), [len(at)]))
        self.cuts = np.concatenate(([0], np.searchsorted(at, breaks), [len(at)]))
        self.text_lines = np.searchsorted(np.concatenate(([0], breaks + 1)), begins)

    @property
    def sizes(self) -> np.ndarray:
        """Words of each line."""
        return np.diff(self.cuts)

    def place(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The text that a line is in, and its number there."""
        text = np.searchsorted(self.text_lines, line, side="right") - 1
        return text, line - self.text_lines[text]

    @cached_property
    def _sums(self) -> np.ndarray:
        return prefix(fold(self.words))

    @cached_property
    def _other_sums(self) -> np.ndarray:
        return prefix(fold(mix(self.words ^ np.uint64(0xA5A5A5A5A5A5A5A5))))

    def value(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A hash of the words a to b, wherever they stand."""
        return span(self._sums, a, b)

    def nodes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(self.value(a, b) + (b - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def checks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Another hash of them, so that the two together tell 10^15 sequences apart."""
        return mix(span(self._other_sums, a, b))

    @cached_property
    def shingles(self) -> np.ndarray:
        """The shingle that each word begins; in the last words of a text it doesn't count."""
        return all_shingles(self.words)

    @cached_property
    def ends(self) -> np.ndarray:
        """Of each word, the end of its text."""
        return np.repeat(self.firsts[1:], np.diff(self.firsts))

    def sets(self) -> list[np.ndarray]:
        """The sorted distinct shingles of each text."""
        every = zip(self.firsts[:-1].tolist(), self.firsts[1:].tolist(), strict=True)
        return [np.unique(self.shingles[a : b - SIZE + 1]) if b - a >= SIZE else shingles(self.words[a:b]) for a, b in every]


def slices(batch: pa.RecordBatch, text_col: str = "text"):
    """Parts of an Arrow batch with about ``SLICE`` characters each, and their texts."""
    texts, at = batch.column(text_col).to_pylist(), 0
    while at < len(texts):
        size, end = len(texts[at] or ""), at + 1
        while end < len(texts) and size + len(texts[end] or "") <= SLICE:
            size, end = size + len(texts[end] or ""), end + 1
        yield batch.slice(at, end - at), texts[at:end]
        at = end


def source(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tk, text) of the rows that have a text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tk"), F.col(text_col).alias("text")).where(F.length(text_col) > 0)


def at_places(texts: DataFrame, places: DataFrame, make, schema: str, fields: tuple[str, ...] = ("line",)) -> DataFrame:
    """Applies ``make`` to Arrow batches of (text, nodes, and lists of ``fields``) of the texts at some places (node, first)."""
    # the places of one text
    wanted = places.groupBy("first.doc_id", "first.tk").agg(F.collect_list("node").alias("nodes"), *(F.collect_list(f"first.{c}").alias(f"{c}s") for c in fields))
    found = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["tk"] == wanted["tk"])).select("text", "nodes", *(f"{c}s" for c in fields))
    return found.mapInArrow(make, schema)


def take_out(docs: DataFrame, kept: DataFrame, min_words: int, *, id_col: str = "doc_id", text_col: str = "text", out: str = "dedup") -> DataFrame:
    """``docs`` with a struct column ``out``: text without the lines of ``min_words`` words or more that aren't at a
    place of ``kept`` (first), n_lines, and the removed line numbers."""
    out = fresh(docs, out)
    tk, lines, mark = fresh(docs, "tk"), fresh(docs, "kept_lines"), fresh(docs, "kept_of")
    stay = kept.groupBy(F.col("first.doc_id").alias(mark), F.col("first.tk").alias(tk)).agg(F.collect_set("first.line").alias(lines))
    keyed = docs.withColumn(tk, F.xxhash64(text_col))
    joined = keyed.join(stay, (keyed[tk] == stay[tk]) & F.col(id_col).cast("long").eqNullSafe(stay[mark]), "left").select(*(keyed[c] for c in docs.columns), lines)
    kind = pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("removed", pa.list_(pa.int32()))])

    def cut(batches):
        for batch in batches:
            rows = []
            for text, stay_here in zip(batch.column(text_col).to_pylist(), batch.column(lines).to_pylist(), strict=True):
                if text is None:
                    rows.append({"text": None, "n_lines": 0, "removed": []})
                    continue
                here, parts = set(stay_here or ()), text.split("\n")
                gone = [i for i, line in enumerate(parts) if i not in here and _long(line, min_words)]
                lost = set(gone)
                rows.append({"text": "\n".join(x for i, x in enumerate(parts) if i not in lost) if gone else text, "n_lines": len(parts), "removed": gone})
            keep = [i for i, c in enumerate(batch.schema.names) if c != lines]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(rows, kind)], [*(batch.schema.names[i] for i in keep), out])

    fields = [T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("removed", T.ArrayType(T.IntegerType()))]
    return joined.mapInArrow(cut, T.StructType([*docs.schema.fields, T.StructField(out, T.StructType(fields))]))


def _long(line: str, min_words: int) -> bool:
    return len(line.encode("utf-8", "surrogatepass").split()) >= min_words
