"""Removal of long repeated byte strings by a blockwise difference-cover suffix sort.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else.
The suffixes' order as such isn't needed, only which of them tie over
``length`` bytes, so the blockwise construction is cut down to that:

1. *Cover sample.* ``cover(r)`` is a difference cover of period v: whatever two
   positions i and j, some shift below v takes both into the sample. So two
   suffixes that tie over ``length`` bytes have sample suffixes, less than v
   further on, that tie over ``length - v + 1`` bytes. The ranks of the sample
   are precomputed as classes of equal strings (64-bit fingerprints), and a
   suffix near which every sample rank is unique can't tie: it is settled.
2. *Buckets.* The other suffixes are counted, dealt to as many buckets as they
   ask for by the fingerprint of their first ``length`` bytes, and each bucket
   is sorted by itself, in memory of its own.

Both steps are one exchange of packed arrays (``_repeats``). A task first sorts
what it holds itself: suffixes that tie within its chunk are settled there and
send one fingerprint as a witness, so a string that occurs a billion times
reaches its bucket once for each chunk. Chunks grow with the number of buckets,
up to ``MOST_CHUNK_BYTES``, so that what a chunk sends to a bucket stays a row
worth sending. Copies of a text are one text from the start: it goes as a whole.

Fingerprints are polynomials modulo the prime 2^61 - 1, which don't depend on
the position; two different strings count as equal only if their fingerprints
and those of a sample within them collide, each by a chance of its length in
2^61, however regular the text is. The bytes themselves aren't compared again.

Defined cases: a null or short text keeps all its bytes; copies of a text of
``length`` bytes or more go as a whole, each of them; repeated rows are copies;
an empty table gives an empty table; a very long text is hashed in stretches, whole;
a column whose name clashes with ``out`` gives it underscores.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.common import Workspace, fresh
from tidewheel.llm.shingles import BYTE, mix, prefix, span

LENGTH, COVER = 400, 2
#: Text bytes that a task sorts as one chunk at least and at most, packed bytes that a bucket holds, about, bytes of a
#: packed suffix, and suffixes that a chunk sends to a bucket at least, while chunks may grow.
CHUNK_BYTES, MOST_CHUNK_BYTES, BUCKET_BYTES, PACKED, CELL = 4 << 20, 64 << 20, 16 << 20, 12, 100
#: Bytes whose running hashes are held at once; longer texts are hashed in stretches.
STRETCH = 4 << 20


def cover(r: int) -> tuple[int, np.ndarray]:
    """A difference cover of 6r + 4 residues modulo 24r^2 + 36r + 13 (the construction by Colbourn and Ling)."""
    gaps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.cumsum([0, *gaps])


def fingerprints(raw: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Of raw[p : p + length] for each p of at, which ascends."""
    out = np.empty(len(at), np.uint64)
    for first in range(0, len(raw), STRETCH):
        a, b = np.searchsorted(at, [first, first + STRETCH])
        if a < b:
            h, p = prefix(BYTE[raw[first : first + STRETCH + length]]), at[a:b] - first
            out[a:b] = mix(span(h, p, p + length))
    return out


def spread(ranges: np.ndarray) -> np.ndarray:
    """The numbers in disjoint ascending ranges (rows of first, end)."""
    sizes = ranges[:, 1] - ranges[:, 0]
    return np.repeat(ranges[:, 0] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())


def merged(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Ranges, ascending by their first, as disjoint ranges; touching ones are one."""
    if not len(first):
        return np.empty((0, 2), np.int64)
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.concatenate(([True], first[1:] > reach[:-1])))
    return np.stack([first[new], reach[np.concatenate((new[1:] - 1, [len(first) - 1]))]], 1)


def _packed(x: np.ndarray) -> bytes:
    """Ascending numbers as differences, which compress."""
    return np.diff(x, prepend=0).astype("<u4").tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(x, "<u4").astype(np.int64))


_SENT = "bucket int, chunk long, kind int, a binary, b binary, seen binary"
DIRECTORY, SUFFIXES, SETTLED = range(3)


def _chunks(length: int, positions, buckets: int, chunk_bytes: int):
    """Arrow batches with key and text (and what ``positions`` needs) to packed rows."""

    def flush(keys, sizes, at, prints):
        offsets = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        place = np.concatenate([p + o for p, o in zip(at, offsets, strict=True)])
        prints = np.concatenate(prints)
        chunk = int.from_bytes(hashlib.blake2b(np.array(keys, "<i8").tobytes(), digest_size=8).digest(), "little", signed=True)
        order = np.argsort(prints, kind="stable")
        ranked = prints[order]
        same = ranked[1:] == ranked[:-1]
        tied = np.concatenate((same, [False])) | np.concatenate(([False], same))
        settled = np.sort(place[order[tied]])
        witness = np.unique(ranked[tied])
        alone = np.sort(order[~tied])  # by place again
        own = chunk % buckets
        yield own, chunk, DIRECTORY, np.array(keys, "<i8").tobytes(), offsets.astype("<i8").tobytes(), np.array(sizes, "<i8").tobytes()
        if len(settled):
            yield own, chunk, SETTLED, _packed(settled), b"", b""
        to, seen_to = (prints[alone] % np.uint64(buckets)).astype(np.int64), (witness % np.uint64(buckets)).astype(np.int64)
        by, seen_by = np.argsort(to, kind="stable"), np.argsort(seen_to, kind="stable")
        cut, seen_cut = np.searchsorted(to[by], np.arange(buckets + 1)), np.searchsorted(seen_to[seen_by], np.arange(buckets + 1))
        for k in range(buckets):
            some, seen = alone[by[cut[k] : cut[k + 1]]], witness[seen_by[seen_cut[k] : seen_cut[k + 1]]]
            if len(some) or len(seen):
                yield k, chunk, SUFFIXES, prints[some].astype("<u8").tobytes(), _packed(place[some]), seen.astype("<u8").tobytes()

    def send(rows):
        for row in rows:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "chunk", "kind", "a", "b", "seen"])

    def scan(batches):
        keys, sizes, at, prints, held = [], [], [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py()
                raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
                where = positions(batch, i, len(raw))
                if not len(where):
                    continue
                keys.append(batch.column("key")[i].as_py())
                sizes.append(len(raw))
                at.append(where)
                prints.append(fingerprints(raw, where, length))
                held += len(raw)
                if held >= chunk_bytes:
                    yield from send(flush(keys, sizes, at, prints))
                    keys, sizes, at, prints, held = [], [], [], [], 0
        if keys:
            yield from send(flush(keys, sizes, at, prints))

    return scan


def _sort_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket: of each chunk's suffixes, the places of those that tie with another chunk's."""
    pdf = pdf.reset_index(drop=True)
    through = pdf[pdf["kind"] != SUFFIXES]
    rows = pdf[pdf["kind"] == SUFFIXES]
    out = [through[["chunk", "kind", "a", "b", "seen"]]]
    if len(rows):
        prints = [np.frombuffer(x, "<u8") for x in rows["a"]]
        ranked = np.concatenate([*prints, *(np.frombuffer(x, "<u8") for x in rows["seen"])])
        ranked.sort()
        tied = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
        found = []
        for chunk, own, places in zip(rows["chunk"], prints, rows["b"], strict=True):
            near = np.searchsorted(tied, own)
            hit = _unpacked(places)[np.concatenate((tied, [np.uint64(0)]))[near] == own] if len(tied) else ()
            if len(hit):
                found.append((chunk, SETTLED, _packed(hit), b"", b""))
        out.append(pd.DataFrame(found, columns=["chunk", "kind", "a", "b", "seen"]))
    return pd.concat(out)


def _by_text(to_ranges):
    """One chunk: the tied places of each text, as ranges made by ``to_ranges(places, size)``."""

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        directory = pdf[pdf["kind"] == DIRECTORY]
        hits = [_unpacked(x) for x in pdf.loc[pdf["kind"] == SETTLED, "a"]]
        rows = []
        if len(directory) and hits:
            keys, offsets, sizes = (np.frombuffer(directory[c].iloc[0], "<i8") for c in ("a", "b", "seen"))
            places = np.sort(np.concatenate(hits))
            cut = np.searchsorted(places, np.concatenate((offsets, [offsets[-1] + sizes[-1]])))
            for i in range(len(keys)):
                if cut[i] < cut[i + 1]:
                    ranges = to_ranges(places[cut[i] : cut[i + 1]] - offsets[i], int(sizes[i]))
                    if len(ranges):
                        rows.append((keys[i], ranges.astype("<i8").tobytes(), int((ranges[:, 1] - ranges[:, 0]).sum())))
        return pd.DataFrame(rows, columns=["key", "ranges", "n"])

    return gather


def _repeats(texts: DataFrame, length: int, positions, to_ranges, suffixes: float, chunk_bytes: int, bucket_bytes: int) -> DataFrame:
    """(key, ranges, n) of the texts that have suffixes, of those ``positions`` names, tied over length bytes; n is the
    ranges' length. ``suffixes``: how many there are, so that no bucket grows with the input, and their share of bytes."""
    buckets = max(1, int(suffixes * PACKED / bucket_bytes))
    sent = texts.mapInArrow(_chunks(length, positions, buckets, chunk_bytes), _SENT)
    tied = sent.groupBy("bucket").applyInPandas(_sort_bucket, "chunk long, kind int, a binary, b binary, seen binary")
    return tied.groupBy("chunk").applyInPandas(_by_text(to_ranges), "key long, ranges binary, n long")


def repeated_ranges(docs: DataFrame, *, text_col: str = "text", length: int = LENGTH, r: int = COVER, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(key, ranges): the byte ranges to remove of each text that has some; key is the text's xxhash64."""
    ws = Workspace(docs.sparkSession, "suffix-dedup")
    v, residues = cover(r)
    if length <= v:
        raise ValueError(f"length must exceed the cover's period, {v}")
    texts = docs.select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")).where(F.octet_length(text_col) >= length)
    # a text that stands twice goes as a whole; the others are compared with one of its copies
    texts = texts.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    size = F.octet_length("text").cast("long")
    copied = ws.save(texts.where("copies > 1").select("key", size.alias("size")), "copied")
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    texts = texts.drop("copies")

    def grown(suffixes, total):
        """Bytes of a chunk that sends CELL suffixes to each bucket."""
        buckets = suffixes * PACKED / bucket_bytes
        return max(chunk_bytes, min(MOST_CHUNK_BYTES, int(CELL * buckets * total / max(suffixes, 1))))

    def sample(batch, i, size):
        p = (np.arange(0, size, v)[:, None] + residues).ravel()
        return p[p <= size - (length - v + 1)]

    def open_starts(p, size):  # suffixes with a tied sample less than v further on
        found = merged(np.maximum(p - v + 1, 0), p + 1)
        found[:, 1] = np.minimum(found[:, 1], size - length + 1)
        return found[found[:, 0] < found[:, 1]]

    samples = total * len(residues) / v
    ranks = ws.save(_repeats(texts, length - v + 1, sample, open_starts, samples, grown(samples, total), bucket_bytes), "open")
    opened = ranks.agg(F.sum("n")).first()[0] or 0  # in natural text about a sixth, at worst all of it

    def named(batch, i, size):
        return spread(np.frombuffer(batch.column("ranges")[i].as_py(), "<i8").reshape(-1, 2))

    def covered(p, size):
        return merged(p, p + length)

    found = _repeats(texts.join(ranks.drop("n"), "key"), length, named, covered, opened, grown(opened, total), bucket_bytes).drop("n")
    whole = copied.select("key", "size", F.lit(0).cast("long").alias("first"))
    removed = found.join(copied, "key", "left_anti").unionByName(whole.mapInArrow(_as_ranges, "key long, ranges binary"))
    return ws.save(removed, "removed")


def _as_ranges(batches):
    for batch in batches:
        rows = np.stack([batch.column("first").to_numpy(), batch.column("size").to_numpy()], 1).astype("<i8")
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([r.tobytes() for r in rows], pa.binary())], ["key", "ranges"])


def remove_repeats(docs: DataFrame, *, text_col: str = "text", out: str = "dedup", **options) -> DataFrame:
    """``docs`` with a struct column ``out``: n_bytes, n_removed, spans removed (``[start, end)`` in bytes), kept bytes."""
    out, key, ranges = fresh(docs, out), fresh(docs, "key"), fresh(docs, "ranges")
    removed = repeated_ranges(docs, text_col=text_col, **options).withColumnsRenamed({"key": key, "ranges": ranges})
    joined = docs.withColumn(key, F.xxhash64(text_col)).join(removed, key, "left")
    kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())])

    def cut(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part, rows = batch.slice(first, 256), []
                for text, spans in zip(part.column(text_col).to_pylist(), part.column(ranges).to_pylist(), strict=True):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    spans = np.frombuffer(spans or b"", "<i8").reshape(-1, 2).tolist()
                    ends = [0, *(x for s in spans for x in s), len(raw)]
                    rows.append({"n_bytes": len(raw), "n_removed": sum(b - a for a, b in spans), "spans": spans, "kept": b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))})
                keep = [i for i, c in enumerate(part.schema.names) if c not in (key, ranges)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array(rows, kind)], [*(part.schema.names[i] for i in keep), out])

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept", T.BinaryType())]
    return joined.mapInArrow(cut, T.StructType([*(f for f in joined.schema.fields if f.name not in (key, ranges)), T.StructField(out, T.StructType(fields))]))


def report(docs: DataFrame) -> DataFrame:
    """One row per document."""
    out = remove_repeats(docs.select("doc_id", "text"), out="d")
    return out.select("doc_id", F.col("d.n_bytes").alias("n_bytes"), F.col("d.n_removed").alias("n_removed"), F.size("d.spans").cast("long").alias("n_spans"), F.sha2("d.kept", 256).alias("kept_sha256"))
