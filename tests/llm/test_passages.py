"""Repeated passages against plain loops, and the hashes that stand for words and lines."""

import random
import re

import numpy as np
import pytest

from tests.llm import brute
from tests.llm.test_operators import WORDS, docs, edited, empty, prose, rows  # noqa: F401
from tidewheel.llm import line_dedup, minhash, paragraph_dedup
from tidewheel.llm.lines import Texts
from tidewheel.llm.shingles import P, prefix, span, times

W, REACH = paragraph_dedup.MIN_WORDS, paragraph_dedup.REACH


def units(text):
    """(first word, words, whether a window) of the lines and windows of a text, windows by a plain loop over the shingles' hashes."""
    ws, out, at = brute.words(text), [], 0
    for line in (text or "").split("\n"):
        n = len(brute.words(line))
        if n >= W:
            out.append((at, ws[at : at + n], False))
        at += n
    hashes = [int(x) for x in Texts([text]).shingles][: max(0, len(ws) - 4)]
    least = {p for a in range(len(hashes) - REACH + 1) for p in range(a, a + REACH) if hashes[p] == min(hashes[a : a + REACH])}
    at = [p for p in sorted(least) if (p == 0 or hashes[p] != hashes[p - 1]) and p + W <= len(ws)]
    return out + [(p, ws[p : p + W], True) for p in at]


def linked(places):
    """Least index in reach; windows meet at their anchor only, lines anywhere, equal words always."""
    sets, parent = [brute.shingles(p[2]) for p in places], list(range(len(places)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(places)):
        for b in range(a + 1, len(places)):
            one, two = places[a], places[b]
            both = len(sets[a] & sets[b])
            windows = {one[3], two[3]} == {True} and one[2][:5] == two[2][:5]
            if one[2] == two[2] or (windows or {one[3], two[3]} == {False}) and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(places))]


def expected(table):
    """(removed words, words that repeat in other texts) of each (doc_id, text)."""
    order = sorted({(d is not None, d or 0, t) for d, t in table if t}, key=lambda x: x[:2])
    places = [(k, w, ws, window) for k, (_, _, t) in enumerate(order) for w, ws, window in units(t)]
    places.sort(key=lambda x: (x[0], x[1], len(x[2])))
    roots = linked(places)
    texts_of = {}
    for (k, *_), r in zip(places, roots, strict=True):
        texts_of.setdefault(r, set()).add(k)
    gone, repeated = [set() for _ in order], [set() for _ in order]
    for i, ((k, w, ws, _), r) in enumerate(zip(places, roots, strict=True)):
        if r != i:
            gone[k].update(range(w, w + len(ws)))
        if len(texts_of[r]) > 1:
            repeated[k].update(range(w, w + len(ws)))
    return {(d if known else None, t): (gone[k], len(repeated[k])) for k, (known, d, t) in enumerate(order)}


def check(spark, table):
    want = expected(table)
    found = paragraph_dedup.dedup_paragraphs(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert len(found) == len(table)
    for r in found:
        gone, repeated = want.get((r.doc_id, r.text), (set(), 0))
        assert {w for a, b in r.dedup.removed for w in range(a, b)} == gone
        assert r.dedup.n_repeated == repeated
        kept = [w for n, w in enumerate(brute.words(r.text)) if n not in gone]
        assert brute.words(r.dedup.text) == kept
        assert (r.dedup.text is None) == (r.text is None) and r.dedup.n_words == len(brute.words(r.text))
    return {r.doc_id: r for r in found}


def test_paragraphs_against_brute_force(spark, rows):  # noqa: F811
    """Texts with equal (doc_id, text) excepted, order among texts of one id is by hash, so ids are made distinct."""
    check(spark, [(None if r[0] is None else i, r[1]) for i, r in enumerate(rows)])


def test_passages_inside_and_across_lines(spark):
    rng = random.Random(8)
    table, planted = [], []
    for k in range(30):
        passage = prose(rng, rng.randrange(50, 90))
        for d in range(3):
            ws = passage.split(" ")
            if d == 1:
                ws = [w.upper() + ("\n" if rng.random() < 0.1 else "") for w in ws]
            inner = " ".join(ws)
            joint = rng.choice([" ", "\n"])
            planted.append(len(table))
            table.append((len(table), joint.join((prose(rng, rng.randrange(0, 120)), inner, prose(rng, rng.randrange(0, 120))))))
    clean = range(len(table), len(table) + 40)
    shared = prose(rng, 30)  # under a window
    table += [(i, f"{prose(rng, 80)} {shared} {prose(rng, 5)}\n{prose(rng, 40)}") for i in clean]
    got = check(spark, table)
    assert all(got[i].dedup.n_repeated >= W for i in planted)
    assert all(not got[i].dedup.n_repeated and not got[i].dedup.removed for i in clean)
    assert all(bool(got[i].dedup.removed) == (i % 3 > 0) and (i % 3 == 0 or got[i].dedup.kept_ids[0] % 3 == 0) for i in planted)


def test_group_of_edited_paragraphs(spark):
    """Many edits of one paragraph, from one word to a third of them."""
    rng = random.Random(9)
    base = prose(rng, 60)
    table = [(i, f"{prose(rng, 12)}\n{edited(rng, base, i % 18)}") for i in range(150)]
    check(spark, table)


def test_clashing_columns_and_empty_tables(spark, docs, empty):  # noqa: F811
    wide = docs.selectExpr("*", "doc_id as dedup", "doc_id as tk", "doc_id as mark", "doc_id as found")
    out = paragraph_dedup.dedup_paragraphs(wide)
    assert out.columns == [*wide.columns, "dedup_"] and out.count() == docs.count()
    assert paragraph_dedup.dedup_paragraphs(empty).isEmpty()


def thue_morse(n, a, b):
    return [(a, b)[bin(i).count("1") % 2] for i in range(n)]


def test_regular_lines_and_words_are_told_apart(spark):
    """Lines of 1,024 words, and words of 1,024 letters, in Thue-Morse order and its complement."""
    one, two = (" ".join(thue_morse(1024, *x)) for x in (("left", "right"), ("right", "left")))
    long_a, long_b = ("".join(thue_morse(1024, *x)) for x in ("ab", "ba"))
    table = [(1, one), (2, two), (3, f"{long_a} c d e f g"), (4, f"{long_b} h i j k l")]
    docs = spark.createDataFrame(table, "doc_id long, text string")  # noqa: F811
    assert {r.doc_id: r.dedup.removed for r in line_dedup.dedup_lines(docs, min_words=1).collect()} == {i: [] for i in (1, 2, 3, 4)}
    nodes = Texts([one, two])
    assert len(set(nodes.nodes(nodes.firsts[:-1], nodes.firsts[1:]).tolist())) == len(set(nodes.checks(nodes.firsts[:-1], nodes.firsts[1:]).tolist())) == 2
    assert len(set(Texts([long_a, long_b]).words.tolist())) == 2
    sets = {frozenset(brute.shingles(brute.words(t))) for t in (one, two)}
    got = {r.doc_id: r.component_id for r in minhash.report(docs).collect()}
    assert len({got[3], got[4]}) == 2
    assert (got[1] == got[2]) == (len(sets) == 1 or 100 * len(set.intersection(*map(set, sets))) >= 85 * len(set.union(*map(set, sets))))


@pytest.mark.parametrize("n", [3, 1000, 70_000])
def test_arithmetic_modulo_the_prime(n):
    rng, p = np.random.default_rng(n), int(P)
    a, b = (rng.integers(0, p, n, dtype=np.int64).astype(np.uint64) for _ in range(2))
    a[:2], b[:2] = p - 1, p - 1
    assert times(a, b).tolist() == [x * y % p for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    h = prefix(a)
    twice = prefix(np.concatenate((b[:1], a)))
    first, end = np.arange(n // 2), np.arange(n // 2) + n // 3
    assert np.array_equal(span(h, first, end), span(twice, first + 1, end + 1))


def test_words_of_a_batch():
    texts = ["One  two\nthree", None, "", "\n\n x", "é́ü\x0b日本 " + "z" * 200, " tail "]
    batch = Texts(texts)
    plain = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for t in texts]
    assert np.diff(batch.firsts).tolist() == [len(ws) for ws in plain]
    seen = {}
    for h, w in zip(batch.words.tolist(), sum(plain, []), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    lines = [(i, n) for i, t in enumerate(texts) for n in range(len((t or "").split("\n")))]
    where, number = batch.place(np.arange(len(batch.sizes)))
    assert list(zip(where.tolist(), number.tolist(), strict=True)) == lines
