"""Removal of copied and slightly edited lines by a deletion-neighbourhood join.

A line of ``MIN_WORDS`` words or more goes if an earlier line, here or in
another document, is equal or within an edit bound of one word (one word
inserted, left out or changed), whether or not that one stays itself. Lines are
compared by their words, with A-Z as a-z; earlier means by (doc_id, text, line
number).

Copies of a line are one row from the start. Two different lines within the
bound agree on a half: on their first or last ``(n - 1) / 2`` words, n being the
longer one's length. Lines whose halves nobody shares can have no partner and
are settled by that alone, which loses nothing. The others emit all variants
within the bound, themselves and with each one word left out, as hashed keys,
and equal variants meet: lines that left out their i-th word each differ in
that word, and a line equal to a variant lacks that word. In both cases only
the earliest line of a key is needed, so keys are aggregates, and no pairs of
the lines of a key are made. The word sequences of each line and its earliest
partner are compared before the line goes.

Lines are copies if two hashes of their words agree, of 61 bits each, modulo a
prime.

Defined cases: null texts stay null, empty ones empty; short and blank lines
stay; a text that loses all its lines becomes empty; rows alike in id and text
share one fate, so a repeated row keeps what its twin keeps; rows without an id
come first; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import Workspace
from tidewheel.llm.lines import Texts, at_places, slices, source, take_out
from tidewheel.llm.shingles import fold, minus, mix, powers, prefix, times

MIN_WORDS = 6


def _halves(min_words: int, edit_words: int):
    """Each line of a batch of texts: its two hashes and, from edit_words words, the keys of its halves, if it were the
    longer or the shorter one."""
    names = ["doc_id", "tk", "line", "node", "other", "k1", "k2", "k3", "k4"]

    def scan(batches):
        for batch in batches:
            for part, texts in slices(batch):
                lines = Texts(texts)
                at = np.flatnonzero(lines.sizes >= min_words)
                a, b = lines.cuts[at], lines.cuts[at + 1]
                n = b - a
                keys = [mix(lines.value(x, y) + (y - x).astype(np.uint64) * np.uint64(k)) for m in (n // 2, (n + 1) // 2) for x, y, k in ((a, a + m, 3), (b - m, b, 5))]
                text, number = lines.place(at)
                ids = [part.column(c).take(pa.array(text)) for c in ("doc_id", "tk")]
                hashes = [pa.array(x.view(np.int64)) for x in (lines.nodes(a, b), lines.checks(a, b))]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(number, pa.int32()), *hashes, *(pa.array(k.view(np.int64), mask=n < edit_words) for k in keys)], names)

    return scan


def _words(batches):
    """The word hashes of lines, by node."""
    for batch in batches:
        nodes, words = [], []
        for text, some, lines in zip(*(batch.column(c).to_pylist() for c in ("text", "nodes", "lines")), strict=True):
            all_lines = Texts([text])
            for node, line in zip(some, lines, strict=True):
                nodes.append(node)
                words.append(all_lines.words[all_lines.cuts[line] : all_lines.cuts[line + 1]].astype("<u8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(words, pa.binary())], ["node", "words"])


def _variants(batches):
    """(node, variant, gap): each line itself (gap -1), and without its word number gap."""
    for batch in batches:
        for first in range(0, batch.num_rows, 1024):
            part = batch.slice(first, 1024)
            raw = part.column("words").to_pylist()
            nodes, sizes = part.column("node").to_numpy(), np.array([len(x) // 8 for x in raw])
            begin = np.concatenate(([0], np.cumsum(sizes)))
            line = np.repeat(np.arange(len(raw)), sizes)
            word = np.arange(begin[-1])
            gap = word - begin[line]
            h = prefix(fold(np.frombuffer(b"".join(raw), "<u8")), gap)
            shorter = fold(minus(h[word], h[begin[line]]) + times(minus(h[begin[line + 1]], h[word + 1]), powers(1)[1][1]))
            variants = mix(np.concatenate((minus(h[begin[1:]], h[begin[:-1]]), shorter)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((nodes, nodes[line]))), pa.array(variants.view(np.int64)), pa.array(np.concatenate((np.full(len(raw), -1), gap)), pa.int32())], ["node", "variant", "gap"])


def _within_one(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether one word inserted, left out or changed, or none, makes a of b."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    ahead = int(np.argmin(np.append(a[:n] == b[:n], False)))
    back = int(np.argmin(np.append((a[::-1][:n] == b[::-1][:n]), False)))
    return ahead + back >= max(len(a), len(b)) - 1


def _verify(batches):
    for batch in batches:
        ok = [_within_one(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(batch.column("mine").to_pylist(), batch.column("theirs").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("node").filter(pa.array(ok, pa.bool_()))], ["node"])


def kept_places(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, edit_words: int = MIN_WORDS) -> DataFrame:
    """(node, first): the lines of at least min_words words that stay, by their places. Those of fewer than edit_words are
    compared for equality only."""
    ws = Workspace(docs.sparkSession, "line-dedup")
    texts = source(docs, id_col, text_col)
    halves = texts.mapInArrow(_halves(min_words, edit_words), "doc_id long, tk long, line int, node long, other long, k1 long, k2 long, k3 long, k4 long")
    keys = ["k1", "k2", "k3", "k4"]
    lines = ws.save(halves.groupBy("node", "other", *keys).agg(F.min(F.struct("doc_id", "tk", "line")).alias("first")), "lines")
    by_key = lines.select("node", F.explode(F.array(*keys)).alias("k")).where("k is not null")
    shared = by_key.groupBy("k").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a != b").select("k")
    open_nodes = by_key.join(shared, "k", "left_semi").select("node").distinct()
    open_lines = ws.save(lines.select("node", "first").join(open_nodes, "node"), "open")
    words = ws.save(at_places(texts, open_lines, _words, "node long, words binary"), "words")
    variants = words.mapInArrow(_variants, "node long, variant long, gap int")
    met = variants.groupBy("variant").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a != b").select("variant")
    met = ws.save(variants.join(met, "variant", "left_semi").join(open_lines, "node"), "met")

    earliest = lambda when: F.min(F.when(when, F.struct("first", "node")))
    changed = met.where("gap >= 0").groupBy("variant", "gap").agg(earliest(F.lit(True)).alias("e"))
    shorter = met.groupBy("variant").agg(earliest(F.col("gap") < 0).alias("whole"), earliest(F.col("gap") >= 0).alias("without")).where("whole is not null and without is not null")
    partners = (
        met.join(changed, ["variant", "gap"]).select("node", "first", "e"),
        met.where("gap >= 0").join(shorter, "variant").select("node", "first", F.col("whole").alias("e")),
        met.where("gap < 0").join(shorter, "variant").select("node", "first", F.col("without").alias("e")),
    )
    pairs = partners[0].unionByName(partners[1]).unionByName(partners[2]).where("e.first < first")
    pairs = pairs.groupBy("node").agg(F.min("e").alias("e")).select("node", F.col("e.node").alias("partner"))
    mine, theirs = words.withColumnRenamed("words", "mine"), words.select(F.col("node").alias("partner"), F.col("words").alias("theirs"))
    edited = pairs.join(mine, "node").join(theirs, "partner").select("node", "mine", "theirs").mapInArrow(_verify, "node long")
    kept = ws.save(lines.select("node", "first").join(edited, "node", "left_anti"), "kept")
    return kept


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, out: str = "dedup") -> DataFrame:
    """``docs`` with a struct column ``out``: text that stays, n_lines, removed line numbers."""
    kept = kept_places(docs, id_col=id_col, text_col=text_col, min_words=min_words)
    return take_out(docs, kept, min_words, id_col=id_col, text_col=text_col, out=out)


def report(docs: DataFrame) -> DataFrame:
    """One row per document; every line that isn't blank is compared."""
    out = dedup_lines(docs.select("doc_id", "text"), min_words=1, out="d")
    return out.select("doc_id", F.col("d.n_lines").alias("n_lines"), F.size("d.removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("d.text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def replace_text(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts that stay, every line that isn't blank compared, and n_chars, where there is such a column,
    to match. A document all of whose lines are copies of earlier ones is a copy itself, and goes."""
    out = dedup_lines(docs, min_words=1)
    dedup = out.columns[-1]
    left = F.col(dedup)["text"]
    emptied = (F.size(F.col(dedup)["removed"]) > 0) & ~left.rlike(r"[^ \x09-\x0D]")
    texts = {c: left if c == "text" else F.length(left).cast(docs.schema[c].dataType) if c == "n_chars" else F.col(c) for c in docs.columns}
    return out.where(~F.coalesce(emptied, F.lit(False))).select(*(v.alias(c) for c, v in texts.items()))
