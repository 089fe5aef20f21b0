"""Clashing columns, very long texts, ties, and the language machines against plain loops."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tidewheel.llm import crf_quality, decontaminate, langid, line_dedup, ring_shards

CLASH = "doc_id long, text string, lang string, shard int, slot int, _cell int, dedup string, tk string, kept_lines int, quality_score string, language string, line_scores int"


def row(i, text, lang="en"):
    return (i, text, lang, 1, 2, 3, "d", "t", 4, "q", "l", 5)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    en, fr = [f"{a}{b}" for a in ("th", "wh", "ing", "st") for b in ("e", "an", "or", "ly")], [f"{a}{b}" for a in ("é", "eau", "qu", "ch") for b in ("le", "aux", "ère", "on")]
    rows = [row(i, "\n".join(" ".join(rng.choices(en if i % 2 else fr, k=12)) for _ in range(4)), "en" if i % 2 else "fr") for i in range(60)]
    rows += [row(60, rows[0][1]), row(61, None), row(62, "", None), row(63, "123 !?", "en"), rows[5], row(64, " ".join(rng.choices(en, k=60_000)) + "\n" + "x" * 200_000, None)]
    return spark.createDataFrame(rows, CLASH)


def test_clashing_columns_stay(spark, docs):
    """Results get underscores behind their names; the table's own columns and values stay."""
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    made = {
        "shard_": ring_shards.assign(docs.drop("text"), 3), "dedup_": line_dedup.dedup_lines(docs), "language_": langid.identify(docs, langid.train(docs)),
        "quality_score_": crf_quality.score(docs, crf_quality.train(docs, labels)),
    }
    for name, out in made.items():
        assert name in out.columns and len(set(out.columns)) == len(out.columns)
        rows = out.collect()
        assert len(rows) == docs.count() and all((r["shard"], r["slot"], r["_cell"], r["dedup"], r["language"], r["quality_score"]) == (1, 2, 3, "d", "l", "q") for r in rows)


def test_very_long_texts(spark, docs):
    """A text of half a million characters gets what its words and lines say, whole."""
    found = {r.doc_id: r.language_ for r in langid.identify(docs, langid.train(docs)).collect()}
    assert found[64].lang == "en" and found[63].lang == found[62].lang == found[61].lang == "und"
    long = docs.where("doc_id = 64").first().text
    words = decontaminate.words_of(long)
    item = spark.createDataFrame([(7, b" ".join(words[-12:-1]).decode())], "item_id long, text string")
    hit = decontaminate.report(docs, item).where("doc_id = 64").first()
    assert hit.n_words == len(words) and hit.n_items == 1 and hit.n_hit >= 11
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    scored = {r.doc_id: r.quality_score_ for r in crf_quality.score(docs, crf_quality.train(docs, labels)).collect()}
    assert 0 <= scored[64].score <= 1 and len(scored[64].line_scores) == 2 and scored[61].score == scored[62].score


def plain_features(text):
    """Damped counts of hashed 1- to 3-grams of bytes, scaled to length 1."""
    b, counts = text.lower().encode(), Counter()
    for n in (1, 2, 3):
        for k in range(len(b) - n + 1):
            value = b[k]
            if n > 1:
                value = b[k] * 257 + b[k + 1]
            if n > 2:
                value = value * 263 + b[k + 2]
            counts[((value + n - 1) * 2654435761 % (1 << 32)) >> 21] += 1
    out = np.zeros(langid.WIDTH)
    for k, c in counts.items():
        out[k] = math.sqrt(c)
    return out / np.linalg.norm(out)


def plain_vote(machine, x):
    """The class with most pairwise wins, of equal ones that with most trust, then the first; and its trust."""
    if len(machine.classes) == 1:
        return machine.classes[0], 1.0
    wins, trust = Counter(), Counter()
    for (a, b), w in zip(machine.pairs, machine.weights, strict=True):
        p = 1 / (1 + math.exp(-3 * (float(np.dot(x, w[:-1])) + w[-1])))
        wins[a] += p > 0.5
        wins[b] += 1 - p > 0.5
        trust[a] += p
        trust[b] += 1 - p
    best = max(range(len(machine.classes)), key=lambda k: (round(wins[k] + trust[k] / (len(machine.classes) + 1) ** 2, 9), -k))
    return machine.classes[best], trust[best] / (len(machine.classes) - 1)


def test_languages_equal_a_plain_version(spark):
    """Features, votes and scores on the given documents, by loops over bytes and pairs."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(table)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.report(table).collect()}
    for r in table.collect():
        if not r.text or not langid._LETTER.search(r.text):
            assert got[r.doc_id] == ("und", 0.0)
            continue
        x = plain_features(r.text)
        assert np.allclose(x, langid.features(r.text), atol=1e-5)
        family, trust = plain_vote(model.families, x)
        lang, more = plain_vote(model.within[model.families.classes.index(family)], x)
        assert got[r.doc_id][0] == lang and abs(got[r.doc_id][1] - min(1, max(0, trust * more))) < 1e-4


def test_ties_of_votes():
    """Three classes that beat each other in a ring: the one with the larger sum of margins, of equal ones the first."""
    machine = langid.Pairwise(["a", "b", "c"], np.zeros((0, 1), np.float32), [])
    machine.weights = np.array([[0.0, 1.0], [0.0, -1.0], [0.0, 1.0]])  # a beats b, c beats a, b beats c
    assert machine.predict(np.zeros((1, 1)))[0].tolist() == [0]
    machine.weights = np.array([[0.0, 1.0], [0.0, -2.0], [0.0, 1.0]])
    assert machine.predict(np.zeros((1, 1)))[0].tolist() == [2]


def test_lines_that_tie(spark):
    """Of equal lines in one document the first stays, of equal ones in several the least doc_id's."""
    line = "one two three four five six seven"
    rows = [(2, f"{line}\n{line}\nother words that nobody else has here"), (1, f"short\n{line}"), (3, "short")]
    got = {r.doc_id: r.dedup.removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=1).collect()}
    assert {k: list(v) for k, v in got.items()} == {1: [], 2: [0, 1], 3: [0]}
