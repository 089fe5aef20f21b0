"""Language identification in two steps: first the family, then the language within it.

Features are hashed byte n-grams (1 to 3 bytes of the lower-cased text) of the
whole text, damped by square roots and scaled to length 1. A one-versus-one
linear support vector machine for each pair of families votes for the family;
within it, one for each pair of its languages votes for the language. The score
is the product of both steps' confidences.

Training is on the driver on a bounded sample: about ``PER_LANG`` documents of
each language, chosen by hash, and ``PER_LANG * 2`` times the number of
languages at most.

Defined cases: ``und`` with score 0 where the text is null or holds no letter;
rows whose language is null or ``und`` aren't learned from; with one language
learned, everything else is that language with score 1, with none ``und``;
repeated rows are predicted alike.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.common import fresh
from tidewheel.llm.crf_quality import held_out

WIDTH, PER_LANG, STEPS = 2048, 600, 200

# Families of ISO 639-1 codes. A code that isn't here is a family of its own.
FAMILIES = {
    "germanic": "af da de en is lb nl no sv",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "indo-aryan": "bn gu hi mr ne pa ur",
    "turkic": "az kk tr uz",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = re.compile(r"[^\W\d_]")


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], lang)


def features(text: str) -> np.ndarray:
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(263) + b[2:]
    x = np.zeros(WIDTH, np.float32)
    for i, grams in enumerate((b, two, three)):
        hashed = (grams + np.uint32(i)) * np.uint32(2654435761) >> np.uint32(21)
        x += np.bincount(hashed, minlength=WIDTH)
    x = np.sqrt(x)
    return x / max(float(np.linalg.norm(x)), 1e-9)


def svm(x: np.ndarray, y: np.ndarray, steps: int = STEPS, c: float = 30.0) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss for y in -1, 1; classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    w, momentum = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    rate = 1 / (1 + 4 * c)
    for step in range(steps):
        ahead = w + step / (step + 3) * momentum
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - rate * (ahead - 2 * c * (x.T @ (share * y * slack)))
        momentum, w = new - w, new
    return w


class Pairwise:
    """One-versus-one machines over some classes."""

    def __init__(self, classes: list[str], x: np.ndarray, y: list[str]):
        self.classes, labels = classes, np.array(y)
        self.pairs = list(combinations(range(len(classes)), 2))
        rows = []
        for a, b in self.pairs:
            here = (labels == classes[a]) | (labels == classes[b])
            rows.append(svm(x[here], np.where(labels[here] == classes[a], 1.0, -1.0)))
        self.weights = np.array(rows).reshape(len(rows), x.shape[1] + 1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class number with most votes (ties: the larger sum of margins) and its confidence."""
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        p = 1 / (1 + np.exp(-3 * margins))
        votes, trust = np.zeros((len(x), len(self.classes))), np.zeros((len(x), len(self.classes)))
        for k, (a, b) in enumerate(self.pairs):
            for cls, won in ((a, p[:, k]), (b, 1 - p[:, k])):
                votes[:, cls] += won > 0.5
                trust[:, cls] += won
        best = np.argmax(votes + trust / (len(self.classes) + 1) ** 2, 1)
        return best, trust[np.arange(len(x)), best] / (len(self.classes) - 1) if self.pairs else np.ones(len(x))


class Hierarchy:
    def __init__(self, x: np.ndarray, langs: list[str]):
        families = [family_of(lang) for lang in langs]
        self.families = Pairwise(sorted(set(families)), x, families)
        self.within = []
        for family in self.families.classes:
            here = [i for i, f in enumerate(families) if f == family]
            self.within.append(Pairwise(sorted({langs[i] for i in here}), x[here], [langs[i] for i in here]))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, trust = self.families.predict(x)
        langs, trust = [""] * len(x), trust.copy()
        for f, machine in enumerate(self.within):
            here = np.flatnonzero(family == f)
            if len(here):
                lang, more = machine.predict(x[here])
                trust[here] *= more
                for i, k in zip(here.tolist(), lang.tolist(), strict=True):
                    langs[i] = machine.classes[k]
        return langs, np.clip(trust, 0, 1)


def train(docs: DataFrame, *, folds: int = 3, fold: int = 1, per_lang: int = PER_LANG) -> Hierarchy | None:
    learn = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null and lang != 'und'").where(~held_out(F.col("doc_id"), folds, fold))
    counts = {r[0]: r[1] for r in learn.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return None
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    odds = F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, per_lang / n))))

    def extract(batches):
        for batch in batches:
            rows = [(lang, features(t).astype("<f2").tobytes()) for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True) if _LETTER.search(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "x"])

    sample = learn.where(draw < odds[F.col("lang")]).select("lang", "text").mapInArrow(extract, "lang string, x binary")
    found = sample.limit(2 * per_lang * len(counts)).collect()
    if not found:
        return None
    found.sort(key=lambda r: (r.lang, bytes(r.x)))
    return Hierarchy(np.stack([np.frombuffer(r.x, "<f2").astype(np.float32) for r in found]), [r.lang for r in found])


def identify(docs: DataFrame, model: Hierarchy | None, *, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out``: lang and score."""
    out = fresh(docs, out)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH numbers for each pair of languages of a family

    def scan(batches):
        hierarchy, kind = shared.value, pa.struct([("lang", pa.string()), ("score", pa.float64())])
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column(text_col).to_pylist()
                rows = [{"lang": "und", "score": 0.0} for _ in texts]
                full = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if hierarchy else []
                if full:
                    langs, scores = hierarchy.predict(np.stack([features(texts[i]) for i in full]))
                    for i, lang, value in zip(full, langs, scores.tolist(), strict=True):
                        rows[i] = {"lang": lang, "score": value}
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, kind)], [*part.schema.names, out])

    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField(out, kind)]))


def report(docs: DataFrame) -> DataFrame:
    """One row per document."""
    out = identify(docs.select("doc_id", "text"), train(docs), out="l")
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), F.col("l.lang").alias("lang_pred"), F.col("l.score").alias("score"))
