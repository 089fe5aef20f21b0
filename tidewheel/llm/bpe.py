"""BPE encoding and decoding; long texts by tree concatenation.

Short texts are encoded whole. A text of over ``long_chars`` characters is cut
into pieces that Spark deals to all tasks; neighbouring encodings are then
joined pairwise, level by level. Around each join a window of original text is
encoded again and grows until its tokens agree with both sides over ``AGREE``
characters. From there on the merges on either side cannot depend on what lies
beyond the window: a token sequence is the BPE encoding of a text exactly if
each pair of neighbouring tokens is that of its own text, and every such pair
then lies within one of the three encodings. A window that has grown over both
sides is simply the encoding itself, so the result is exact in any case.

Window ends are taken at ASCII characters that begin a token, where neither
Unicode composition nor a token of several characters crosses, and ``AGREE`` is
more than twice the longest special token, so that none can straddle unseen.

Where neither a token nor a normalisation step crosses ASCII white space, which
is checked for each tokenizer (``splits_at_spaces``), a text is encoded word by
word between two spaces, each distinct word once (``Words``); a piece keeps
token positions only for the stretches at its ends. With other tokenizers texts
and pieces are encoded whole.

Defined cases: a null text is encoded as the empty text: no ids, empty decoded
text; repeated rows get equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import collections
import json
import os
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.common import fresh, partitions, text_key

PIECE_CHARS, LONG_CHARS, AGREE = 16_384, 32_768, 32
#: Characters of texts that are encoded together, words that are remembered, and characters of a piece's ends.
SLICE_CHARS, WORDS_HELD, END_CHARS = 1_000_000, 300_000, 1024

RESULT = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])


@lru_cache(maxsize=2)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


_BLANK = str.maketrans("\n\r\t", "   ")


_SAMPLES = ("ab", "Don't", "x1", "!?", "\u00e9\u0302", "\u65e5\u672c", "<|", "'s", "A", "7.5")


def splits_at_spaces(tokenizer) -> bool:
    """Whether ASCII white space only parts words: no token crosses or marks it, so words can be encoded one by one."""
    spec = json.loads(tokenizer.to_str())
    steps = [spec["pre_tokenizer"], *((spec["pre_tokenizer"] or {}).get("pretokenizers") or ())]
    # words are what a pattern finds, and what it doesn't find is dropped
    if not any(s and s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"] for s in steps) or spec["post_processor"] or spec["model"]["type"] != "BPE" or spec["model"].get("dropout"):
        return False
    if any(t["lstrip"] or t["rstrip"] or set(t["content"]) & set(" \n\r\t") for t in spec["added_tokens"]):
        return False
    ids = lambda x: tokenizer.encode(x, add_special_tokens=False).ids
    return all(ids(f"{x}{gap}{y}") == ids(x) + ids(y) for x in _SAMPLES for y in _SAMPLES for gap in (" ", "\n", "\r\n", "\t ")) and not ids(" \n\t\r ")


class Words:
    """The ids and decoded texts of texts, each distinct word between ASCII spaces encoded once and remembered.

    New words are encoded together, parted by a special token. With a tokenizer
    whose tokens may cross white space, texts are encoded whole.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.by_word = tokenizer, splits_at_spaces(tokenizer)
        self.recent, self.older = {"": (b"", "")}, {}
        self.plain = tokenizer.decoder is None  # decoding sets a space between any two tokens
        special = [(i, t) for i, t in tokenizer.get_added_tokens_decoder().items() if not (t.single_word or t.lstrip or t.rstrip or t.normalized)]
        self.parting, self.mark = (special[0][0], special[0][1].content) if special else (None, None)

    def _ids(self, words: list[str]) -> list[bytes]:
        if self.mark is None or any(self.mark in w for w in words):
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(words)], add_special_tokens=False)[0].ids, "<u4")
        cut = np.concatenate(([-1], np.flatnonzero(ids == self.parting), [len(ids)])).tolist()
        raw = ids.tobytes()
        return [raw[4 * a + 4 : 4 * b] for a, b in zip(cut, cut[1:], strict=False)]

    def _decoded(self, ids: list[bytes]) -> list[str]:
        return self.tokenizer.decode_batch([np.frombuffer(i, "<u4").tolist() for i in ids], skip_special_tokens=False)

    def code(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """The ids and the decoded text of each text."""
        if not self.by_word:
            ids = [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            return ids, self._decoded(ids)
        split = [t.translate(_BLANK).split(" ") for t in texts]
        if len(self.recent) > WORDS_HELD:  # words that come again are found among the older ones
            self.recent, self.older = {"": (b"", "")}, self.recent
        held, older, long = self.recent, self.older, {}
        new = set().union(*split).difference(held)
        for word in new.intersection(older):
            held[word] = older[word]
        new = list(new.difference(older))
        for at in range(0, len(new), 1024):
            some = new[at : at + 1024]
            ids = self._ids(some)
            for word, pair in zip(some, zip(ids, self._decoded(ids) if self.plain else ids, strict=True), strict=True):
                (held if len(word) <= 64 else long)[word] = pair
        every = held if not long else collections.ChainMap(long, held)
        coded = [[every[w] for w in words] for words in split]
        ids = [b"".join([x for x, _ in pairs]) for pairs in coded]
        return ids, [" ".join([x for _, x in pairs if x]) for pairs in coded] if self.plain else self._decoded(ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.code(texts)[0]


class Coded:
    """Token ids of a stretch of text and the character each begins and ends at, in the whole text."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.ids, self.starts, self.ends = ids, starts, ends

    @classmethod
    def of(cls, tokenizer, text: str, at: int) -> Coded:
        e = tokenizer.encode(text, add_special_tokens=False)
        offsets = np.array(e.offsets, np.int64).reshape(-1, 2) + at
        return cls(np.array(e.ids, np.uint32), offsets[:, 0], offsets[:, 1])

    def cut(self, a: int, b: int) -> Coded:
        return Coded(self.ids[a:b], self.starts[a:b], self.ends[a:b])

    def __add__(self, other: Coded) -> Coded:
        return Coded(*(np.concatenate(x) for x in ((self.ids, other.ids), (self.starts, other.starts), (self.ends, other.ends))))


def _clean_starts(c: Coded, text: str) -> np.ndarray:
    """Numbers of tokens that begin at an ASCII character which no earlier token reaches."""
    if not len(c.ids):
        return np.empty(0, np.int64)
    reach = np.concatenate(([-1], np.maximum.accumulate(c.ends)[:-1]))
    near = np.flatnonzero((c.starts >= reach) & (c.ends > c.starts))
    return near[[text[i] < "\x80" for i in c.starts[near]]] if len(near) else near


def _run(a: Coded, i: int, b: Coded, j: int) -> int:
    """How many tokens agree from token i of a and token j of b on."""
    n = min(len(a.ids) - i, len(b.ids) - j)
    same = (a.ids[i : i + n] == b.ids[j : j + n]) & (a.starts[i : i + n] == b.starts[j : j + n]) & (a.ends[i : i + n] == b.ends[j : j + n])
    return n if same.all() else int(np.argmin(same))


def join(tokenizer, text: str, left: Coded, right: Coded, begin: int, middle: int, end: int) -> Coded:
    """The encoding of text[begin:end] from those of text[begin:middle] and text[middle:end]."""
    left_ok, right_ok = _clean_starts(left, text), _clean_starts(right, text)
    grow = 4 * AGREE
    while True:
        i = left_ok[left.starts[left_ok] <= middle - grow]
        j = right_ok[right.starts[right_ok] >= middle + grow]
        i, j = (int(i[-1]) if len(i) else None), (int(j[0]) if len(j) else None)
        a, b = begin if i is None else int(left.starts[i]), end if j is None else int(right.starts[j])
        window = Coded.of(tokenizer, text[a:b], a)
        head = _agrees_left(left, i, window)
        tail = _agrees_right(right, j, window, middle)
        if head is not None and tail is not None:
            return left.cut(0, head) + window.cut(0, tail[0]) + right.cut(tail[1], len(right.ids))
        grow *= 2


def _agrees_left(left: Coded, i: int | None, window: Coded) -> int | None:
    """The number of tokens to keep of the left side, or None."""
    if i is None:
        return 0
    n = _run(left, i, window, 0)
    return i if n >= 2 and left.ends[i + n - 1] - left.starts[i] >= AGREE else None


def _agrees_right(right: Coded, j: int | None, window: Coded, middle: int) -> tuple[int, int] | None:
    """The numbers of tokens before which the window ends and the right side goes on, or None."""
    if j is None:
        return len(window.ids), len(right.ids)
    first = lambda c: np.flatnonzero(np.diff(c.starts, prepend=-1) > 0)
    mine, theirs = first(window), first(right.cut(0, j))
    mine = mine[window.starts[mine] >= middle]
    shared, x, y = np.intersect1d(window.starts[mine], right.starts[theirs], return_indices=True)
    for p, q in zip(mine[x].tolist(), theirs[y].tolist(), strict=True):
        n = _run(window, p, right, q)
        if n >= 2 and window.ends[p + n - 1] - window.starts[p] >= AGREE:
            return p, q
    return None


def cuts(text: str, piece: int) -> list[int]:
    """Where to cut: about every ``piece`` characters, at an ASCII character where one is near."""
    at = [0]
    while len(text) - at[-1] > piece * 3 // 2:
        near = at[-1] + piece
        at.append(next((i for i in range(near, near + min(256, piece // 4)) if text[i] < "\x80"), near))
    return [*at, len(text)]


class Piece:
    """The encoding of a stretch of text: coded ends with positions, and plain ids between them.

    Without ``tail`` the whole stretch is ``head``. ``head_end`` and
    ``tail_begin`` are white space, where encodings meet exactly.
    """

    def __init__(self, head: Coded, head_end: int, ids: list[np.ndarray], tail: Coded | None, tail_begin: int):
        self.head, self.head_end, self.ids, self.tail, self.tail_begin = head, head_end, ids, tail, tail_begin

    @classmethod
    def of(cls, words: Words, text: str, at: int) -> Piece:
        first, last = text.find(" ", END_CHARS), text.rfind(" ", 0, max(len(text) - END_CHARS, 0))
        if first < 0 or last <= first or not words.by_word:
            return cls(Coded.of(words.tokenizer, text, at), at + len(text), [], None, at)
        middle = np.frombuffer(words.encode([text[first:last]])[0], "<u4")
        return cls(Coded.of(words.tokenizer, text[:first], at), at + first, [middle], Coded.of(words.tokenizer, text[last:], at + last), at + last)

    def join(self, tokenizer, text: str, begin: int, middle: int, end: int, other: Piece) -> Piece:
        left, right = self.head if self.tail is None else self.tail, other.head
        both = join(tokenizer, text, left, right, begin if self.tail is None else self.tail_begin, middle, end if other.tail is None else other.head_end)
        if self.tail is None:
            return Piece(both, other.head_end, other.ids, other.tail, other.tail_begin if other.tail else begin)
        if other.tail is None:
            return Piece(self.head, self.head_end, self.ids, both, self.tail_begin)
        return Piece(self.head, self.head_end, [*self.ids, both.ids, *other.ids], other.tail, other.tail_begin)

    def all_ids(self) -> np.ndarray:
        return np.concatenate([self.head.ids, *self.ids, *([self.tail.ids] if self.tail else [])])


def concatenate(tokenizer, text: str, at: list[int], parts: list[Piece]) -> np.ndarray:
    """Joins neighbours, level by level. ``at``: where the parts begin, and the text's end."""
    while len(parts) > 1:
        pairs = range(0, len(parts) - 1, 2)
        joined = [parts[k].join(tokenizer, text, at[k], at[k + 1], at[k + 2], parts[k + 1]) for k in pairs]
        parts, at = joined + parts[len(parts) - len(parts) % 2 :], [at[k] for k in range(0, len(parts), 2)] + [at[-1]]
    return parts[0].all_ids()


def _whole(path: str, text_col: str, out: str):
    arrow = pa.struct([("ids", pa.binary()), ("decoded", pa.string())])

    def encode(batches):
        words = Words(load(path))
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            at = 0
            while at < len(texts):
                size, end = len(texts[at]), at + 1
                while end < len(texts) and end - at < 1024 and size + len(texts[end]) <= SLICE_CHARS:
                    size, end = size + len(texts[end]), end + 1
                ids, decoded = words.code(texts[at:end])
                rows = pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], fields=list(arrow))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, end - at) for c in batch.columns), rows], [*batch.schema.names, out])
                at = end

    return encode


def encode(docs: DataFrame, tokenizer_path: str, *, text_col: str = "text", out: str = "bpe", piece_chars: int = PIECE_CHARS, long_chars: int = LONG_CHARS) -> DataFrame:
    """``docs`` with a struct column ``out``: ids (little-endian unsigned 32-bit) and decoded text.

    Only texts of over ``long_chars`` are shuffled: their pieces, then the
    pieces' tokens; the task that joins holds one text.
    """
    out = fresh(docs, out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, RESULT)])
    size = F.coalesce(F.length(text_col), F.lit(0))
    short = docs.where(size <= long_chars).mapInArrow(_whole(tokenizer_path, text_col, out), schema)
    key = fresh(docs, "text_key")
    long = docs.where(size > long_chars).withColumn(key, text_key(F.col(text_col)))
    coded = encode_long(long.select(F.col(key).alias("k"), F.col(text_col).alias("t")), tokenizer_path, piece_chars)
    joined = long.join(coded.withColumnsRenamed({"k": key, "r": out}), key).select(*docs.columns, out)
    return short.unionByName(joined)


def encode_long(texts: DataFrame, tokenizer_path: str, piece_chars: int) -> DataFrame:
    """From (k, t): one row (k, r) for each k."""

    def cut(batches):
        for batch in batches:
            for k, t in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist(), strict=True):
                at = cuts(t, piece_chars)
                for first in range(0, len(at) - 1, 64):
                    some = range(first, min(first + 64, len(at) - 1))
                    yield pa.RecordBatch.from_pydict({"k": [k] * len(some), "i": pa.array(some, pa.int32()), "at": pa.array([at[i] for i in some], pa.int32()), "t": [t[at[i] : at[i + 1]] for i in some]})

    coded_end = lambda c: [x.astype("<u4").tobytes() for x in (c.ids, c.starts, c.ends - c.starts)]

    def code(batches):
        words = Words(load(tokenizer_path))
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1)
                p = Piece.of(words, row.column("t")[0].as_py(), 0)
                plain = p.ids[0].tobytes() if p.ids else b""
                ends = [coded_end(p.head), coded_end(p.tail) if p.tail else None]
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([p.head_end], pa.int32()), pa.array([p.tail_begin], pa.int32()), pa.array([plain], pa.binary()), *(pa.array([e], pa.list_(pa.binary())) for e in ends)], coded_names)

    coded_names = ["k", "i", "at", "t", "head_end", "tail_begin", "plain", "head", "tail"]

    def concat(pdf: pd.DataFrame) -> pd.DataFrame:
        tokenizer = load(tokenizer_path)
        pdf = pdf.drop_duplicates("i").sort_values("i")

        def whole(end, at):
            ids, starts, sizes = (np.frombuffer(x, "<u4") for x in end)
            starts = starts.astype(np.int64) + at
            return Coded(ids, starts, starts + sizes)

        parts = []
        for row in pdf.itertuples():
            tail = None if row.tail is None else whole(row.tail, row.at)
            parts.append(Piece(whole(row.head, row.at), row.at + row.head_end, [np.frombuffer(row.plain, "<u4")], tail, row.at + row.tail_begin))
        text = "".join(pdf["t"])
        ids = concatenate(tokenizer, text, [*pdf["at"].tolist(), len(text)], parts)
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "ids": [ids.astype("<u4").tobytes()], "decoded": [tokenizer.decode(ids.tolist(), skip_special_tokens=False)]})

    n = partitions(texts.sparkSession)
    texts = texts.groupBy("k").agg(F.first("t").alias("t"))  # copies of a text are encoded once
    pieces = texts.mapInArrow(cut, "k binary, i int, at int, t string").repartition(n, "k", "i")
    coded = pieces.mapInArrow(code, "k binary, i int, at int, t string, head_end int, tail_begin int, plain binary, head array<binary>, tail array<binary>")
    whole = coded.groupBy("k").applyInPandas(concat, "k binary, ids binary, decoded string")
    return whole.select("k", F.struct("ids", "decoded").alias("r"))


def report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per document: the digest columns of :func:`encode`."""
    coded = encode(docs.select("doc_id", "text"), tokenizer_path, out="r")
    return coded.select("doc_id", (F.length("r.ids") / 4).cast("long").alias("n_tokens"), F.sha2("r.ids", 256).alias("ids_sha256"), F.sha2(F.col("r.decoded").cast("binary"), 256).alias("decoded_sha256"))
