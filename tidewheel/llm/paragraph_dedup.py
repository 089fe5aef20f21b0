"""Removal of passages that repeat across documents, by MinHash banding of paragraphs.

A paragraph is a stretch of ``MIN_WORDS`` words or more: a line, or a window of
just so many words that begins at an anchor. Anchors are shingles whose hash is
the least in some run of ``REACH`` shingles, so where they lie follows from the
words around them alone: any ``MIN_WORDS + REACH - 1`` (50) words in a row that
stand in two texts share a window, within a longer line or over line breaks.

A line goes into a bucket for each of ``BANDS`` bands of ``ROWS`` minima of its
five-word shingles, tuned for recall: a pair of Jaccard similarity 0.8 shares
no band with a probability of 2e-4, one of 0.9 with 4e-7. Windows of one passage
begin at the same minimum by construction, and a word changed before the last
``TAIL`` already costs more shingles than 0.8 leaves, so a window goes into one
bucket, by its words up to those; lines are so compared with lines, and windows
with those of the same anchor. Paragraphs that meet in a bucket are joined and
their exact similarity confirmed, and components of the confirmed links
(:mod:`tidewheel.llm.near`) are the clusters: the earliest paragraph of each, by
(doc_id, text, word), stays and the words of the others go, with the white space
up to the next word. Copies of a paragraph are one node from the start, if two
hashes of their words agree.

A text *repeats* if a paragraph of it is in a cluster of several texts.

Defined cases: null texts stay null, empty ones empty, and neither repeats;
shorter paragraphs stay; a text that loses all its words keeps the white space
before the first; rows alike in id and text share one fate; rows without an id
come first; very long texts are hashed by themselves, whole; columns whose names
clash with ``out`` give it underscores; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.common import Workspace, fresh
from tidewheel.llm.lines import Texts, at_places, slices, source
from tidewheel.llm.near import SETS, candidates, link, rarity, set_rows
from tidewheel.llm.shingles import SIZE, MinHash, edges, shingles

MIN_WORDS, REACH, BANDS, ROWS, THRESHOLD = 35, 16, 12, 3, 80
#: Words at the end of a window that may differ.
TAIL = 3
#: Minima of the signatures that candidates are compared by first.
SIGNATURE = 256
#: Shingles up to which a paragraph's set is carried in the rows that meet.
FEW = 256


def _sliding(x: np.ndarray, n: int, least_or_most) -> np.ndarray:
    """The least or most of each n items in a row; n is a power of two."""
    step = 1
    while step < n:
        x, step = least_or_most(x[:-step], x[step:]), 2 * step
    return x


def anchors(texts: Texts) -> np.ndarray:
    """The words at which a shingle begins that is the least of some run of ``REACH`` shingles of a text."""
    s, n = texts.shingles, len(texts.words)
    if n < REACH:
        return np.empty(0, np.int64)
    least = _sliding(s, REACH, np.minimum)
    least[np.arange(len(least)) + REACH + SIZE - 1 > texts.ends[: len(least)]] = 0  # runs that leave their text
    pad = np.zeros(REACH - 1, np.uint64)
    found = _sliding(np.concatenate((pad, least, pad)), REACH, np.maximum) == s
    found[1:] &= s[1:] != s[:-1]  # one of equal neighbours
    return np.flatnonzero(found & (s > 0))


def _units(min_words: int, bands: int, rows: int):
    names = ["doc_id", "tk", "word", "size", "node", "other", "bands"]

    def scan(batches):
        family = MinHash(bands, rows)
        for batch in batches:
            for part, some in slices(batch):
                texts = Texts(some)
                at = anchors(texts)
                at = at[at + min_words <= texts.ends[at]]
                line = np.flatnonzero(texts.sizes >= min_words)
                a, b = texts.cuts[line], texts.cuts[line + 1]
                values = family.band_values(family.minima([texts.shingles[x : y - SIZE + 1] for x, y in zip(a.tolist(), b.tolist(), strict=True)])) if len(line) else np.empty((0, bands), np.int64)
                first, end = np.concatenate((at, a)), np.concatenate((at + min_words, b))
                text = np.searchsorted(texts.firsts, first, side="right") - 1
                keys = np.concatenate((texts.nodes(at, at + min_words - TAIL).view(np.int64), values.ravel()))
                offsets = np.concatenate((np.arange(len(at)), len(at) + bands * np.arange(len(a) + 1)))
                hashes = [pa.array(x.view(np.int64)) for x in (texts.nodes(first, end), texts.checks(first, end))]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(pa.array(text)) for c in names[:2]), pa.array(first - texts.firsts[text], pa.int32()), pa.array(end - first, pa.int32()), *hashes, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys))], names
                )

    return scan


def _sets(batches):
    family = MinHash(SIGNATURE // 4, 4)
    for batch in batches:
        nodes, sets = [], []
        for text, some, words, sizes in zip(*(batch.column(c).to_pylist() for c in ("text", "nodes", "words", "sizes")), strict=True):
            all_words = Texts([text]).words
            nodes += some
            sets += [shingles(all_words[w : w + n]) for w, n in zip(words, sizes, strict=True)]
        yield set_rows(pa.array(nodes, pa.int64()), sets, family, FEW)


def clusters(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The paragraphs that have company: (doc_id, tk, word, size, first, across): their text and words, the earliest
    paragraph of the cluster, and whether the cluster is in several texts."""
    ws = Workspace(docs.sparkSession, "paragraph-dedup")
    texts = source(docs, id_col, text_col)
    units = ws.save(texts.mapInArrow(_units(min_words, bands, rows), "doc_id long, tk long, word int, size int, node long, other long, bands array<long>"), "units")
    held = candidates(ws, units.select("node", "bands"))
    copied = units.groupBy("node").agg(F.count("*").alias("c")).where("c > 1").select("node")
    places = ws.save(units.drop("bands").join(held.select("node").union(copied).distinct(), "node", "left_semi"), "places")
    ws.drop("units")
    place = F.struct("doc_id", "tk", "word", "size")
    firsts = ws.save(places.groupBy("node", "other").agg(F.min(place).alias("first")), "firsts")
    wanted = firsts.join(held.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    sets = ws.save(at_places(texts, wanted, _sets, SETS, ("word", "size")), "sets")
    roots = link(ws, held, sets, rarity(ws, sets), threshold, words=SIGNATURE // 64)
    of_root = ws.save(places.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node"), "of_root")
    text = F.struct("doc_id", "tk")
    shared = of_root.groupBy("root").agg(F.count("*").alias("c"), F.min(place).alias("first"), (F.min(text) != F.max(text)).alias("across")).where("c > 1").drop("c")
    return ws.save(of_root.join(shared, "root").select("doc_id", "tk", "word", "size", "first", "across"), "shared")


def _covered(words: list[int], sizes: list[int], n: int) -> np.ndarray:
    """Which of n words lie in the stretches."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.array(words, np.int64), 1)
    np.add.at(step, np.array(words, np.int64) + np.array(sizes, np.int64), -1)
    return np.cumsum(step[:n]) > 0


def dedup_paragraphs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", out: str = "dedup", **options) -> DataFrame:
    """``docs`` with a struct column ``out``: text that stays, n_words, n_repeated (words of paragraphs that stand in
    other texts too), removed (``[start, end)`` in words) and kept_ids, the documents that keep what was removed."""
    shared = clusters(docs, id_col=id_col, text_col=text_col, **options)
    out, tk, mark, found = fresh(docs, out), fresh(docs, "tk"), fresh(docs, "mark"), fresh(docs, "found")
    later = ~F.struct("doc_id", "tk", "word", "size").eqNullSafe(F.col("first"))
    # the paragraphs of one text
    of_text = shared.groupBy(F.col("doc_id").alias(mark), F.col("tk").alias(tk)).agg(
        F.struct(F.collect_list("word").alias("word"), F.collect_list("size").alias("size"), F.collect_list(later).alias("later"), F.collect_list("across").alias("across"), F.array_sort(F.collect_set(F.when(later, F.col("first.doc_id")))).alias("kept")).alias(found)
    )
    keyed = docs.withColumn(tk, F.xxhash64(text_col))
    joined = keyed.join(of_text, (keyed[tk] == of_text[tk]) & F.col(id_col).cast("long").eqNullSafe(of_text[mark]), "left").select(*(keyed[c] for c in docs.columns), found)
    kind = pa.struct([("text", pa.string()), ("n_words", pa.int64()), ("n_repeated", pa.int64()), ("removed", pa.list_(pa.list_(pa.int64()))), ("kept_ids", pa.list_(pa.int64()))])

    def one(text, at):
        raw = (text or "").encode("utf-8", "surrogatepass")
        begins = edges(raw)[0]
        if at is None:
            return {"text": text, "n_words": len(begins), "n_repeated": 0, "removed": [], "kept_ids": []}
        some = lambda which: _covered(*([v for v, x in zip(at[c], at[which], strict=True) if x] for c in ("word", "size")), len(begins))
        gone = np.flatnonzero(np.diff(np.concatenate(([0], some("later").view(np.int8), [0])))).reshape(-1, 2)
        limits = np.append(begins, len(raw))[gone].ravel().tolist()
        limits = [0, *limits, len(raw)]
        left = b"".join(raw[a:b] for a, b in zip(limits[::2], limits[1::2], strict=True)).decode("utf-8", "surrogatepass")
        return {"text": left, "n_words": len(begins), "n_repeated": int(some("across").sum()), "removed": gone.tolist(), "kept_ids": at["kept"]}

    def cut(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                rows = [one(*x) for x in zip(part.column(text_col).to_pylist(), part.column(found).to_pylist(), strict=True)]
                keep = [i for i, c in enumerate(part.schema.names) if c != found]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array(rows, kind)], [*(part.schema.names[i] for i in keep), out])

    fields = [T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_repeated", T.LongType()), T.StructField("removed", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept_ids", T.ArrayType(T.LongType()))]
    return joined.mapInArrow(cut, T.StructType([*docs.schema.fields, T.StructField(out, T.StructType(fields))]))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: whether and in how many words it repeats, words removed, and the documents that keep them."""
    out = dedup_paragraphs(docs.select("doc_id", "text"), out="d")
    removed = F.aggregate("d.removed", F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0])
    return out.select("doc_id", (F.col("d.n_repeated") > 0).alias("repeats"), F.col("d.n_repeated").alias("n_repeated"), removed.alias("n_removed"), F.col("d.kept_ids").alias("kept_doc_ids"), F.sha2(F.coalesce("d.text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
