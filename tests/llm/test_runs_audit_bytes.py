"""Operators 11 to 13 against plain versions and the libraries."""

import base64
import hashlib
import random
import zlib
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute_runs
from tidewheel.llm import byte_bpe, filter_audit, queries, runs

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Columns that clash with names the operators use.
SCHEMA = "doc_id long, text string, lang string, source string, runs string, byte_bpe string, h string, bits int, r string"


def row(i, text, lang="en"):
    return (i, text, lang, "s", "x", "y", "z", 1, "r")


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, repeats, nulls, blanks, one long text, repeated rows, ids that are rearranged."""
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "bdfgk" for b in "aeiou"]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    texts = [prose(rng.randrange(1, 300)) for _ in range(60)]
    texts += [texts[0], texts[0], None, "", None, "  \n\t\x0b ", "a " * 500, "ab ab\nab\tab " * 9 + "cd", "ÀB C#D É $ " * 30, "x y z " * 4 + "x y", prose(25_000), "日本語 日本語 " * 20, "wörd" * 4000]
    rows = [row(i, t, [None, "en", "de", ""][i % 4]) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], rows[3], row(None, texts[1]), row(None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


SEQUENCES = st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=5)


@settings(max_examples=150, deadline=None)
@given(SEQUENCES, st.sampled_from([4, 5, 7, 12]))
def test_runs_of_any_sequences(sequences, least):
    for s, found in zip(sequences, runs.find([np.array(s, np.int64) for s in sequences], least), strict=True):
        assert [tuple(x) for x in found.tolist()] == brute_runs.runs(s, least)


def test_runs_of_repeated_stretches():
    rng = random.Random(8)
    for _ in range(300):
        base = [rng.randrange(rng.choice([2, 4, 50])) for _ in range(rng.randrange(1, 30))]
        s = [rng.randrange(50) for _ in range(rng.randrange(9))] + base * rng.randrange(1, 7) + base[: rng.randrange(len(base))] + [rng.randrange(50) for _ in range(rng.randrange(9))]
        found = runs.find([np.array(s), np.array(base * 3), np.array(s[::-1])])
        for x, r in zip((s, base * 3, s[::-1]), found, strict=True):
            assert [tuple(k) for k in r.tolist()] == brute_runs.runs(x)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=80))
def test_common_extensions_on_the_grammar(s):
    grammar = runs.Grammar(np.array([*s, 9]))
    n = len(s) + 1
    pairs = [(x, y) for x in range(n) for y in range(x + 1, n)]
    if pairs:
        got = grammar.common(*(np.array(c) for c in zip(*pairs, strict=True)))
        for (x, y), k in zip(pairs, got.tolist(), strict=True):
            assert s[x : x + k] == s[y : y + k] and (y + k == len(s) or s[x + k] != s[y + k])


def test_run_report(docs):
    got = sorted((tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in runs.report(docs).collect()), key=str)
    want = []
    for r in docs.collect():
        words = (r.text or "").encode().split()
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n and r.doc_id is not None:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        found = brute_runs.runs(words) if n < 5000 else [tuple(x) for x in runs.find([np.unique(words, return_inverse=True)[1]])[0].tolist()]
        longest = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None,) * 3
        want.append((r.doc_id, len(found), *longest, 1000 * longest[1] // longest[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(b" ".join(brute_runs.collapsed(words, found)))))
    assert got == sorted(want, key=str)
    assert sum(w[1] for w in want) >= 9


def test_run_operator_keeps_columns_and_rows(docs, empty):
    found = runs.find_runs(docs)
    assert found.columns == [*docs.columns, "runs_"]
    by_id = {r.doc_id: r for r in found.collect()}
    assert by_id[66].runs_.runs == [(0, 500, 1)] and by_id[66].runs_.collapsed == "a" and by_id[62].runs_.n_words == 0
    assert found.count() == docs.count()
    assert runs.report(empty).isEmpty() and runs.find_runs(empty).isEmpty()
    with pytest.raises(ValueError):
        runs.find_runs(docs, min_length=3)


def plain_audit(rows, labels):
    """The audit by applying every order to the list of documents."""
    import re

    least = {}
    for r in rows:
        if r.doc_id is not None:
            least[r.text or ""] = min(least.get(r.text or "", r.doc_id), r.doc_id)
    marks = {}
    for i, quality, toxic in labels:
        good, bad = marks.get(i, (False, False))
        marks[i] = (good or quality == 1, bad or toxic == 1)
    fails = {}
    for r in rows:
        t = r.text or ""
        w = [x for x in re.split("[ \t-\r]+", t) if x]
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": r.doc_id is not None and least[t] < r.doc_id}
        fails.setdefault(r.lang or "", []).append(({c for c, x in bad.items() if x}, *(marks.get(r.doc_id, (False, False)) if r.doc_id is not None else (False, False))))
    out = {}
    for part, held in fails.items():
        for order in map("".join, permutations("ABCDE")):
            left = held
            for step, c in enumerate(order, 1):
                gone, stay = [x for x in left if c in x[0]], [x for x in left if c not in x[0]]
                out[part, order, step] = [len(stay), len(gone), sum(c in x[0] for x in held) - len(gone), sum(x[0] == {c} for x in held), sum(x[1] for x in gone), sum(x[2] for x in gone)]
                left = stay
        for c in "ABCDE":
            total = sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == c)
            for (p, o, s), v in out.items():
                if p == part and o[s - 1] == c:
                    v.append(total)
    return out


def test_audit_equals_every_order(spark, docs):
    labels = [(0, 1, 0), (1, 1, 1), (2, 0, 1), (60, 1, 0), (61, None, 1), (61, 1, None), (62, 1, 1), (999, 1, 1), (None, 1, 1), (5, 2, 3)]
    table = spark.createDataFrame([(*x, "n") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = {(r.part, r.filter_order, r.step): [r[c] for c in filter_audit.COUNTS] for r in filter_audit.audit(docs, table).collect()}
    assert got == plain_audit(docs.collect(), labels)
    assert len(got) == 600 * 3


def test_failed_filters_by_document(docs, empty, spark):
    got = {r.doc_id: r.failed for r in filter_audit.failures(docs).collect()}
    assert "E" not in got.get(0, "") and "E" in got[60] and "E" in got[61]
    assert got[62] == "A" and got[63] == "AE" and got[66] == "B" and "D" in got[68] and "C" in got[68]
    assert filter_audit.failures(empty).isEmpty()
    assert filter_audit.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).isEmpty()


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_minimal_perfect_hash():
    vocabulary = byte_bpe.load(RANKS)
    keys = vocabulary._keys(vocabulary.bytes, vocabulary.starts, vocabulary.sizes)
    assert np.array_equal(vocabulary.number(keys), np.arange(len(vocabulary.ranks)))
    tokens = [t for t in list(vocabulary.ranks)[::7]] + [b"no such token", b"\xff\xfe\xff", b"q" * 5000]
    sizes = np.array([len(t) for t in tokens])
    found = vocabulary.find(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes)
    assert found.tolist() == [vocabulary.ranks.get(t, -1) for t in tokens]
    for n in (0, 1, 2, 1000):
        keys = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
        assert sorted(byte_bpe.MinimalPerfectHash(keys)(keys).tolist()) == list(range(n))


PARTS = ["a", "b", "'s", " ", "  ", "\n", " \n", "\x1c", "\x85", "\xa0", "é", "1", "!", "日", "\U0001f600", "'", "ll", "the", " the", "　", "​", "ħ", "<|endoftext|>", "\x00"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), min_size=1, max_size=4))
def test_bytes_equal_the_library(library, texts):
    coder = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    ids, counts = coder.code(texts)
    ends = np.cumsum(counts)
    for t, a, b in zip(texts, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == library.encode_ordinary(t)
        assert coder.vocabulary.decode(ids[a:b]).decode() == t


def test_byte_report_and_columns(docs, empty, library, monkeypatch):
    coded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert coded.columns == [*docs.columns, "byte_bpe_"]
    for r in coded.collect():
        assert r.byte_bpe_.ids == library.encode_ordinary(r.text or "") and r.byte_bpe_.decoded == (r.text or "").encode()
    got = sorted((tuple(r) for r in queries.byte_bpe.report(docs, RANKS, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str)
    ids = [(r.doc_id, library.encode_ordinary(r.text or ""), r.text or "") for r in docs.collect()]
    assert got == sorted(((i, len(x), sha(",".join(map(str, x))), sha(t)) for i, x, t in ids), key=str)
    assert byte_bpe.report(empty, RANKS, public_tokenizers.PATTERN).isEmpty()
    again = byte_bpe.decode(coded.select("doc_id", "byte_bpe_.ids", "text"), RANKS)
    assert all(r.decoded == (r.text or "").encode() for r in again.collect())


def test_long_texts_and_forgetting(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SLICE_CHARS", 50)
    monkeypatch.setattr(byte_bpe, "MERGED_HELD", 3)
    coder = byte_bpe.Codec(byte_bpe.load(RANKS), public_tokenizers.PATTERN)
    rng = random.Random(2)
    for _ in range(40):
        text = "".join(rng.choices(PARTS, k=400))
        assert coder.code_long(text).tolist() == library.encode_ordinary(text)
    assert coder.code_long("zq" * 3000).tolist() == library.encode_ordinary("zq" * 3000)


def test_patterns_that_cross_gaps(library):
    """With a pattern whose matches hold words and spaces, texts aren't cut."""
    pattern = r"\w+ \w+|\s|[^\s]"
    coder = byte_bpe.Codec(byte_bpe.load(RANKS), pattern)
    own = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=library._mergeable_ranks, special_tokens={})
    assert not coder.cuts
    for text in ("one two three", "don't stop now", ""):
        assert coder.code([text])[0].tolist() == own.encode_ordinary(text) and coder.code_long(text).tolist() == own.encode_ordinary(text)
