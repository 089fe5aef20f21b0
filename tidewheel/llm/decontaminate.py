"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Texts and items are normalised alike: ASCII capitals become small letters and
runs of ASCII letters, digits and non-ASCII characters become words. A window
is ``window`` consecutive words of an item (the whole item if it has fewer).
The automaton holds every window once, framed by spaces, so that it matches
whole words only; each text is scanned once, and match ends are mapped back to
word numbers and to character offsets in the original text.

Defined cases: a null or wordless text has no words and no hits; a null or
wordless item has no windows; items with equal windows are all reported; an
item whose id is null marks words but is not reported by id; repeated rows each
get their own result; an empty items table hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.common import Workspace, fresh, text_key

#: Bytes of item text that one automaton holds at most; its trie has up to ``window`` times as many nodes.
AUTOMATON_BYTES = 512 * 1024

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ]
)
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.list_(pa.int32())))])

#: Byte by byte: word bytes stay, A-Z become a-z, all else a space. Non-ASCII characters are word bytes only.
_NORMAL = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split() if text else []


def windows_of(words: list[bytes], window: int) -> Iterator[list[bytes]]:
    if words:
        for i in range(max(1, len(words) - window + 1)):
            yield words[i : i + window]


class Matcher:
    """The automaton of some items: ``(item id or None, text)``."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], window: int):
        import ahocorasick

        owners: dict[str, tuple[int, set[str]]] = {}
        for item_id, text in items:
            for words in windows_of(words_of(text), window):
                key = (b" " + b" ".join(words) + b" ").decode("latin-1")
                owners.setdefault(key, (len(words), set()))[1].update(() if item_id is None else (item_id,))
        self.automaton = None
        if owners:
            self.automaton = ahocorasick.Automaton()
            for key, (n, ids) in owners.items():
                self.automaton.add_word(key, (len(key), n, ids))
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Words in all, disjoint runs of hit word numbers, sorted item ids."""
        words = words_of(text)
        if not words or self.automaton is None:
            return len(words), [], []
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        found = list(self.automaton.iter(line))
        if not found:
            return len(words), [], []
        starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
        change = np.zeros(len(words) + 1, np.int64)
        ids: set[str] = set()
        for end, (size, n, owners) in found:
            first = int(np.searchsorted(starts, end - size + 1))
            change[first] += 1
            change[first + n] -= 1
            ids |= owners
        hit = np.concatenate(([0], (np.cumsum(change)[:-1] > 0).astype(np.int8), [0]))
        edges = np.flatnonzero(np.diff(hit))
        return len(words), list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), sorted(ids)


def character_spans(text: str, runs: list[tuple[int, int]]) -> list[list[int]]:
    """Runs of word numbers as character offsets ``[start, end)`` in the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    is_word = np.frombuffer(raw.translate(_NORMAL), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], is_word.view(np.int8), [0]))))
    char_of = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    first, last = edges[::2], edges[1::2]
    return [[int(char_of[first[a]]), int(char_of[last[b - 1]])] for a, b in runs]


def _scan_with(docs: DataFrame, text_col: str, out: str, items: list[tuple[str | None, str | None]], window: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def scan(batches):
        matcher = Matcher(shared.value, window)
        for batch in batches:
            rows = []
            for text in batch.column(text_col).to_pylist():
                n, runs, ids = matcher.scan(text)
                rows.append({"n_words": n, "n_hit": sum(b - a for a, b in runs), "item_ids": ids, "spans": character_spans(text, runs) if runs else []})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _ARROW)], [*batch.schema.names, out])

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField(out, RESULT)]))


def find_contamination(
    docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, out: str = "contamination", automaton_bytes: int = AUTOMATON_BYTES
) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_hit, item_ids (sorted as strings), spans (``[start, end)``
    in characters of the text).

    The items reach the executors by broadcast only in blocks of at most
    ``automaton_bytes`` of text, measured first. One block takes one narrow pass
    without a shuffle. More blocks take a pass each, whose hits are put together
    by text.
    """
    spark = docs.sparkSession
    out = fresh(docs, out)
    pool = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null").distinct()
    total = pool.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-int(total * 1.25) // automaton_bytes) if total > automaton_bytes else 1
    if blocks == 1:
        return _scan_with(docs, text_col, out, [tuple(r) for r in pool.collect()], window)

    ws = Workspace(spark, "decontaminate")
    pool = ws.save(pool.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(blocks))), "items")
    texts = docs.select(text_key(F.col(text_col)).alias("k"), F.col(text_col).alias("t")).where("t is not null")
    hits = None
    for b in range(blocks):
        some = [(r.i, r.t) for r in pool.where(F.col("b") == b).select("i", "t").collect()]
        found = _scan_with(texts, "t", "c", some, window).where("c.n_hit > 0").select("k", "c.item_ids", "c.spans")
        found = ws.save(found.dropDuplicates(["k"]), f"block{b}")
        hits = found if hits is None else hits.unionByName(found)
    merged = hits.groupBy("k").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.flatten(F.collect_list("spans")).alias("spans"))
    key, some_ids, some_spans = fresh(docs, "text_key"), fresh(docs, f"{out}_i"), fresh(docs, f"{out}_s")
    joined = docs.withColumn(key, text_key(F.col(text_col))).join(merged.withColumnsRenamed({"k": key, "item_ids": some_ids, "spans": some_spans}), key, "left")

    def settle(batches):
        for batch in batches:
            rows = []
            for text, ids, spans in zip(batch.column(text_col).to_pylist(), batch.column(some_ids).to_pylist(), batch.column(some_spans).to_pylist(), strict=True):
                spans = union_spans(spans or [])
                rows.append({"n_words": len(words_of(text)), "n_hit": sum(len(words_of(text[a:b])) for a, b in spans), "item_ids": ids or [], "spans": spans})
            keep = [i for i, c in enumerate(batch.schema.names) if c not in (key, some_ids, some_spans)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(rows, _ARROW)], [*(batch.schema.names[i] for i in keep), out])

    return joined.mapInArrow(settle, T.StructType([*docs.schema.fields, T.StructField(out, RESULT)])).select(*docs.columns, out)


def union_spans(spans: list[list[int]]) -> list[list[int]]:
    """Overlapping spans as one."""
    done: list[list[int]] = []
    for a, b in sorted(spans):
        if done and a <= done[-1][1]:
            done[-1][1] = max(done[-1][1], b)
        else:
            done.append([a, b])
    return done


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: the digest columns of :func:`find_contamination`."""
    found = find_contamination(docs.select("doc_id", "text"), items.select("item_id", "text"), out="c")
    return found.select(
        "doc_id",
        F.col("c.n_words").alias("n_words"),
        F.col("c.n_hit").alias("n_hit"),
        F.size("c.item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("c.item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("c.n_hit") > 0).alias("contaminated"),
    )


def is_clean(contamination: str = "contamination") -> Column:
    return F.col(contamination)["n_hit"] == 0
