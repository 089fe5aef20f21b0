"""Document quality by a linear-chain conditional random field over lines.

Each line is labelled good or bad from features of itself and of its
neighbouring lines; the probability of "good" is a forward-backward marginal,
and a document's score is the mean of its lines' marginals weighted by their
lengths. Training lines carry their document's label.

The model is fitted on the driver on a bounded sample: at most ``MAX_DOCS``
labelled documents of at most ``MAX_LINES`` non-blank lines, half of them of
each label where there are enough, weighted back to the labels' true shares.
Scoring reads every whole text in one narrow pass.

Defined cases: a null, empty or blank text scores 0; blank lines have no part
in a score; a document labelled twice counts as good if one label says so; null
labels are not used; with no usable labels of both kinds every score is the
share of good labels (1 if there are none); repeated rows score alike.
"""

from __future__ import annotations

import unicodedata
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.common import fresh

MAX_DOCS, MAX_LINES, STEPS = 3000, 64, 250
THRESHOLD = 0.3

_KINDS = None
LETTER, UPPER, DIGIT, SPACE, PIPE, BANG, STOP, SYMBOL = range(8)


def _kinds() -> np.ndarray:
    """The kind of each character of the basic plane; others count as symbols."""
    global _KINDS
    if _KINDS is None:
        kinds = np.full(0x10000, SYMBOL, np.uint8)
        for i in range(0x10000):
            group = unicodedata.category(chr(i))
            if group[0] in "LM":
                kinds[i] = UPPER if group == "Lu" else LETTER
            elif group[0] == "N":
                kinds[i] = DIGIT
            elif group[0] in "ZC":
                kinds[i] = SPACE
        kinds[[ord(c) for c in ".,;:?'\"()-"]] = STOP
        kinds[ord("|")], kinds[ord("!")] = PIPE, BANG
        _KINDS = kinds
    return _KINDS


#: Features of a line by itself; each comes again as the mean over the line's neighbours.
OWN = 19
WIDTH = 2 * OWN + 2


def lines_of(text: str | None) -> list[str]:
    return [x for x in text.split("\n") if x and not x.isspace()] if text else []


def features(lines: list[str]) -> np.ndarray:
    """A row of ``WIDTH`` for each line: itself, the mean of its neighbours, whether it is first and last."""
    sizes = np.array([len(x) for x in lines])
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds()[np.minimum(points, 0xFFFF)]
    line_no = np.repeat(np.arange(len(lines)), sizes)
    counts = np.bincount(line_no * 8 + kinds, minlength=8 * len(lines)).reshape(-1, 8).astype(float)
    letters = np.maximum(counts[:, LETTER] + counts[:, UPPER], 1)
    own = np.zeros((len(lines), OWN))
    own[:, 0] = 1
    own[:, 1] = np.log1p(sizes) / 5
    own[:, 2] = counts[:, LETTER] / sizes
    own[:, 3] = counts[:, UPPER] / letters
    own[:, 4] = counts[:, DIGIT] / sizes
    own[:, 5] = counts[:, PIPE] / sizes * 10
    own[:, 6] = counts[:, BANG] / sizes * 10
    own[:, 7] = counts[:, STOP] / sizes * 10
    own[:, 8] = counts[:, SYMBOL] / sizes * 10
    seen: dict[str, int] = {}
    for line in lines:
        seen[line] = seen.get(line, 0) + 1
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        lengths = np.fromiter(map(len, words), float, n) if n else np.zeros(1)
        n = max(n, 1)
        again = sum(map(eq, words, words[1:]))
        own[i, 9:] = (
            np.log1p(n) / 5,
            lengths.mean() / 10,
            min(lengths.max(), 100) / 50,
            len(set(words)) / n,
            again / n,
            sum(map(str.isupper, words)) / n,
            (lengths <= 1).mean(),
            (lengths <= 3).mean(),
            seen[line] > 1,
            line.rstrip()[-1:] in ".?!",
        )
    near, parts = np.zeros_like(own), np.zeros((len(lines), 1))
    near[1:] += own[:-1]
    near[:-1] += own[1:]
    parts[1:] += 1
    parts[:-1] += 1
    near /= np.maximum(parts, 1)
    edge = np.zeros((len(lines), 2))
    edge[0, 0] = edge[-1, 1] = 1
    return np.hstack([own, near, edge])


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def marginals(unary: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over a padded batch: P(label) as (docs, lines, 2), and expected transitions summed over lines
    as (docs, 2, 2). unary: (docs, lines, 2) scores; lines beyond a document's length have probability 0."""
    n, most, _ = unary.shape
    alpha, beta = np.zeros_like(unary), np.zeros_like(unary)
    alpha[:, 0] = unary[:, 0]
    for t in range(1, most):
        live = (t < lengths)[:, None]
        alpha[:, t] = np.where(live, unary[:, t] + _lse(alpha[:, t - 1, :, None] + trans, 1), alpha[:, t - 1])
    for t in range(most - 2, -1, -1):
        live = (t + 1 < lengths)[:, None]
        beta[:, t] = np.where(live, _lse(trans[None] + (unary[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
    z = _lse(alpha[:, -1], 1)
    live = np.arange(most)[None, :] < lengths[:, None]
    p = np.exp(alpha + beta - z[:, None, None]) * live[..., None]
    pair = alpha[:, :-1, :, None] + trans + (unary[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
    moves = (np.exp(np.minimum(pair, 0)) * live[:, 1:, None, None]).sum(1)
    return p, moves


class Crf:
    """Weights of the labels' unary scores on standardised features, and the transition scores."""

    def __init__(self, mean, scale, weights, trans):
        self.mean, self.scale, self.weights, self.trans = mean, scale, weights, trans

    @classmethod
    def fit(cls, docs: list[np.ndarray], labels: np.ndarray, doc_weights: np.ndarray, steps: int = STEPS, decay: float = 2e-3) -> Crf:
        flat = np.vstack(docs)
        mean, scale = flat.mean(0), flat.std(0) + 1e-3
        mean[0], scale[0] = 0, 1
        lengths = np.array([len(d) for d in docs])
        x = np.zeros((len(docs), lengths.max(), flat.shape[1]))
        for i, d in enumerate(docs):
            x[i, : len(d)] = (d - mean) / scale
        w, trans = np.zeros((flat.shape[1], 2)), np.zeros((2, 2))
        truth = np.zeros((*x.shape[:2], 2))
        truth[np.arange(len(docs)), :, labels] = 1
        truth *= (np.arange(x.shape[1])[None, :] < lengths[:, None])[..., None]
        same = np.zeros((len(docs), 2, 2))
        same[np.arange(len(docs)), labels, labels] = lengths - 1
        share = (doc_weights / doc_weights.sum() / lengths)[:, None, None]  # each document counts alike
        m = [np.zeros_like(w), np.zeros_like(trans)]
        v = [np.zeros_like(w), np.zeros_like(trans)]
        for step in range(1, steps + 1):
            p, moves = marginals(x @ w, trans, lengths)
            grads = np.einsum("ntf,ntk->fk", x, (p - truth) * share) + decay * w, ((moves - same) * share).sum(0) + decay * trans
            for k, (g, value) in enumerate(zip(grads, (w, trans), strict=True)):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                value -= 0.05 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return cls(mean, scale, w, trans)

    def line_scores(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """P(good) of each line; documents of like length are scored together."""
        out: list[np.ndarray] = [np.empty(0)] * len(docs)
        order = sorted(range(len(docs)), key=lambda i: len(docs[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at) * len(docs[order[end]]) < 50_000 and len(docs[order[end]]) <= 1.5 * len(docs[order[at]]) + 4:
                end += 1
            some = order[at:end]
            lengths = np.array([len(docs[i]) for i in some])
            unary = np.zeros((len(some), lengths.max(), 2))
            for k, i in enumerate(some):
                unary[k, : lengths[k]] = ((docs[i] - self.mean) / self.scale) @ self.weights
            p, _ = marginals(unary, self.trans, lengths)
            for k, i in enumerate(some):
                out[i] = p[k, : lengths[k], 1]
            at = end
        return out


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, folds: int = 5, fold: int = 0, max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES) -> Crf | float:
    """The model, from labelled documents outside the held-out fold; a constant where a label is missing."""
    usable = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"), folds, fold))
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    shares = dict(usable.groupBy("quality").count().collect())
    # max_docs rows: at most half of them for each label, those of the least hashes
    drawn = [usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs // 2) for q in (0, 1)]
    drawn = drawn[0].unionByName(drawn[1])

    def extract(batches):
        for batch in batches:
            rows = []
            for doc_id, quality, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "quality", "text")), strict=True):
                lines = lines_of(text)
                if 0 < len(lines) <= max_lines:
                    rows.append((doc_id, quality, features(lines).astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["doc_id", "quality", "x"])

    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
    found = sample.select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(extract, "doc_id long, quality int, x binary").dropDuplicates(["doc_id"]).orderBy("doc_id").limit(max_docs).collect()
    y = np.array([r.quality for r in found], np.int64)
    if len(set(y.tolist())) < 2:
        return shares.get(1, 0) / sum(shares.values()) if shares else 1.0
    drawn_shares = np.bincount(y, minlength=2) / len(y)
    weights = np.array([shares[int(q)] / sum(shares.values()) / drawn_shares[q] for q in y])
    return Crf.fit([np.frombuffer(r.x, "<f4").reshape(-1, WIDTH).astype(float) for r in found], y, weights)


def score(docs: DataFrame, model: Crf | float, *, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """``docs`` with a struct column ``out``: score of the text, and line_scores of its non-blank lines."""
    out = fresh(docs, out)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def scan(batches):
        crf = shared.value
        kind = pa.struct([("score", pa.float64()), ("line_scores", pa.list_(pa.float32()))])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                split = [lines_of(t) for t in part.column(text_col).to_pylist()]
                full = [x for x in split if x]
                scores = iter(crf.line_scores([features(x) for x in full]) if isinstance(crf, Crf) else [np.full(len(x), crf) for x in full])
                rows = []
                for lines in split:
                    p = next(scores) if lines else np.empty(0)
                    value = float(np.average(p, weights=[len(x) for x in lines])) if lines else 0.0
                    rows.append({"score": min(max(value, 0.0), 1.0), "line_scores": p.tolist()})
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, kind)], [*part.schema.names, out])

    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("line_scores", T.ArrayType(T.FloatType()))])
    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField(out, kind)]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document."""
    out = score(docs.select("doc_id", "text"), train(docs, labels), out="q")
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.col("q.score").alias("score"), (F.col("q.score") >= THRESHOLD).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject."""
    out = score(docs, train(docs, labels), out="quality_score")
    return out.where(F.col(out.columns[-1])["score"] >= THRESHOLD).select(*docs.columns)
