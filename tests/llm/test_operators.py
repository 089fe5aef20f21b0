import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tidewheel.llm import bpe, crf_quality, decontaminate, langid, line_dedup, media, minhash, near, paragraph_dedup, queries, ring_shards, suffix_dedup
from tidewheel.llm.common import Workspace

DATA = "/root/testdata/sf0.001"
WORDS = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, kept_lines int, contamination string, bpe string"


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def edited(rng, text, n):
    ws = text.split(" ")
    for _ in range(n):
        ws[rng.randrange(len(ws))] = rng.choice(WORDS)
    return " ".join(ws)


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows, clashing columns."""
    rng = random.Random(3)
    base, passage = [prose(rng, 90) for _ in range(6)], prose(rng, 70)
    texts = [*base, base[0], base[0], *(edited(rng, base[1], k % 4) for k in range(8)), None, "", "   \n\t ", "one two", "One  two", "ein Wort"]
    texts += [f"{prose(rng, 30)}\n{passage}\n{prose(rng, 25)}" for _ in range(4)] + [prose(rng, 9000), "é̂" * 900 + "x" * 5000, "!" * 1000, passage.upper()]
    out = [(i * 7 % 101, t, "en", "s", None if t is None else len(t), "n", 1, "c", "b") for i, t in enumerate(texts)]
    return [*out, out[0], out[0], (None, base[2], None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_text(result, *cols):
    return sorted((tuple(r[c] for c in cols) for r in result.collect()), key=str)


def test_decontamination_in_one_and_more_blocks(spark, docs, rows):
    items = [(1, " ".join(rows[0][1].split(" ")[20:45]).upper()), (2, "one TWO"), (3, None), (None, "ein wort"), (10, "no such words at all in any of the documents here today"), (4, ""), (1, rows[3][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        ws = decontaminate.words_of(t)
        for k in range(max(1, len(ws) - 9)) if ws else ():
            windows.setdefault(tuple(ws[k : k + 10]), set()).add(i)
    want = []
    for r in rows:
        ws, hit, ids = decontaminate.words_of(r[1]), set(), set()
        for w, owners in windows.items():
            for k in range(len(ws) - len(w) + 1):
                if tuple(ws[k : k + len(w)]) == w:
                    hit.update(range(k, k + len(w)))
                    ids |= owners
        want.append((r[0], len(ws), len(hit), sorted(str(i) for i in ids if i is not None)))
    for size in (decontaminate.AUTOMATON_BYTES, 300):
        found = decontaminate.find_contamination(docs, table, automaton_bytes=size)
        assert found.columns == [*docs.columns, "contamination_"]
        got = [(r.doc_id, r.contamination_.n_words, r.contamination_.n_hit, r.contamination_.item_ids) for r in found.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        for r in found.where("contamination_.n_hit > 0").collect():
            assert sum(len(decontaminate.words_of(r.text[a:b])) for a, b in r.contamination_.spans) == r.contamination_.n_hit
    assert decontaminate.find_contamination(docs, table.limit(0)).where("contamination_.n_hit > 0").isEmpty()
    wide = docs.selectExpr("*", "1 as contamination__i", "2 as contamination__s")
    assert decontaminate.find_contamination(wide, table, automaton_bytes=300).columns == [*wide.columns, "contamination_"]


def test_empty_tables(spark, empty):
    items, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert decontaminate.report(empty, items).isEmpty()
    assert bpe.report(empty, queries.tokenizer_path()).isEmpty()
    assert suffix_dedup.report(empty).isEmpty()
    assert ring_shards.report(empty).isEmpty()
    assert line_dedup.report(empty).isEmpty()
    assert paragraph_dedup.report(empty).isEmpty()
    assert minhash.report(empty).isEmpty()
    assert crf_quality.report(empty, labels).isEmpty()
    assert langid.report(empty).isEmpty()
    assert media.report(spark.createDataFrame([], "vec_id long, embedding array<float>")).isEmpty()


@pytest.mark.parametrize(("piece", "long"), [(bpe.PIECE_CHARS, bpe.LONG_CHARS), (150, 200)])
def test_bpe_equals_the_library(docs, rows, piece, long):
    tokenizer = bpe.load(queries.tokenizer_path())
    found = bpe.encode(docs, queries.tokenizer_path(), piece_chars=piece, long_chars=long)
    assert found.columns == [*docs.columns, "bpe_"]
    got = found.collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    for r in got:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.bpe_.ids, "<u4").tolist() == ids
        assert r.bpe_.decoded == tokenizer.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("long", [bpe.LONG_CHARS, 200])
def test_bpe_with_tokens_that_hold_spaces(docs, long):
    """A byte-level tokenizer, which can't be taken word by word."""
    path = queries.tokenizer_path("byte_bpe_50k.json")
    tokenizer = bpe.load(path)
    assert not bpe.splits_at_spaces(tokenizer) and bpe.splits_at_spaces(bpe.load(queries.tokenizer_path()))
    for r in bpe.encode(docs.select("doc_id", "text"), path, piece_chars=long // 2, long_chars=long).collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.bpe.ids, "<u4").tolist() == ids
        assert r.bpe.decoded == tokenizer.decode(ids, skip_special_tokens=False)


def test_remembered_words(monkeypatch):
    """Words that hold the special token, long ones, blanks of many kinds, and words forgotten and met again."""
    monkeypatch.setattr(bpe, "WORDS_HELD", 3)
    tokenizer = bpe.load(queries.tokenizer_path())
    words = bpe.Words(tokenizer)
    for texts in (["a<|endoftext|>b c", "  <|endoftext|> x", ""], ["x" * 100 + " y \x1c z", "don't\u00a0stop"], ["a b c d e f", "<|startoftext|> <|end"], ["a x y", "c \u200b d"]):
        ids, decoded = words.code(texts)
        for t, i, d in zip(texts, ids, decoded, strict=True):
            want = tokenizer.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(i, "<u4").tolist() == want and d == tokenizer.decode(want, skip_special_tokens=False)


PARTS = st.sampled_from(["a", "b", "'s", "'", "t", "!", "?", "1", " ", "\n", "\x1c", " ", "é", "é", "̂", "İ", "日", "😀", "<|endoftext|>", "<|", "|>", "aaaa", "the", "ſ"])


@settings(max_examples=150, deadline=None)
@given(st.lists(PARTS, max_size=400).map("".join), st.integers(5, 80))
def test_tree_concatenation_is_exact(text, piece):
    tokenizer = bpe.load(queries.tokenizer_path())
    at = bpe.cuts(text, piece)
    words = bpe.Words(tokenizer)
    parts = [bpe.Piece.of(words, text[a:b], a) for a, b in zip(at, at[1:], strict=False)]
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert bpe.concatenate(tokenizer, text, at, parts).tolist() == want
    assert np.frombuffer(words.encode([text])[0], "<u4").tolist() == want


def test_difference_covers():
    for r in range(4):
        v, d = suffix_dedup.cover(r)
        assert len(d) == 6 * r + 4
        assert {(a - b) % v for a in d.tolist() for b in d.tolist()} == set(range(v))


@pytest.mark.parametrize(("length", "r", "chunk"), [(400, 2, 32 << 20), (100, 1, 2000), (30, 0, 500)])
def test_suffix_dedup(docs, rows, length, r, chunk):
    masks = brute.repeated_bytes([x[1] for x in rows], length)
    want = []
    for x, m in zip(rows, masks, strict=True):
        raw = (x[1] or "").encode()
        want.append((x[0], len(raw), int(m.sum()), int((np.diff(np.concatenate(([0], m.astype(int)))) == 1).sum()), bytes(b for b, gone in zip(raw, m, strict=True) if not gone)))
    found = suffix_dedup.remove_repeats(docs, length=length, r=r, chunk_bytes=chunk, bucket_bytes=5000)
    got = [(x.doc_id, x.dedup.n_bytes, x.dedup.n_removed, len(x.dedup.spans), bytes(x.dedup.kept)) for x in found.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_suffix_dedup_of_regular_texts(spark):
    """Thue-Morse texts, their complements, periodic texts and copies, with many buckets."""
    word = lambda n, a, b: "".join((a, b)[bin(i).count("1") % 2] for i in range(n))
    texts = [word(1500, "a", "b"), word(1500, "b", "a"), word(700, "ab", "ba"), "xyz" * 300, "q" * 500, word(420, "c", "d"), word(420, "c", "d"), word(399, "e", "f"), None, ""]
    masks = brute.repeated_bytes(texts, 400)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("dedup", F.lit(1)).withColumn("key", F.lit(2)).withColumn("ranges", F.lit(3))
    found = suffix_dedup.remove_repeats(docs, bucket_bytes=500)
    assert found.columns == [*docs.columns, "dedup_"]
    got = {r.doc_id: (r.dedup_.n_removed, bytes(r.dedup_.kept)) for r in found.collect()}
    for i, (t, m) in enumerate(zip(texts, masks, strict=True)):
        assert got[i] == (int(m.sum()), bytes(b for b, gone in zip((t or "").encode(), m, strict=True) if not gone))


def test_ring_shards(spark, docs, rows):
    for table, n in ((docs, len(rows)), (spark.range(5000).select(F.lit(7).alias("doc_id"), F.lit("x").alias("text")), 5000), (spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text")), 1000)):
        got = ring_shards.report(table).collect()
        assert len(got) == n
        counts = [sum(r["shard"] == s for r in got) for s in range(24)]
        assert max(counts) - min(counts) <= 1
        for s in range(24):
            assert sorted(r.slot for r in got if r["shard"] == s) == list(range(counts[s]))
    sizes = {r.doc_id: (r["size"], r.text_crc32) for r in ring_shards.report(docs).collect()}
    assert all(sizes[r[0]] == (len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows[1:-3])


def test_ring_moves_little(spark):
    keys = spark.range(8000).withColumnRenamed("id", "doc_id")
    for slack, most in ((0.0, 0.5), (0.25, 0.3)):
        a = {r.doc_id: r["shard"] for r in ring_shards.assign(keys, 8, slack=slack).collect()}
        b = {r.doc_id: r["shard"] for r in ring_shards.assign(keys, 9, slack=slack).collect()}
        assert sum(a[k] != b[k] for k in a) < most * len(a)


def test_line_dedup(docs, rows):
    places = []
    for r in rows:
        for n, line in enumerate((r[1] or "").split("\n")):
            if len(brute.words(line)) >= line_dedup.MIN_WORDS:
                places.append(((r[0] is not None, r[0] or 0), n, tuple(brute.words(line)), r[1]))
    gone = {(p[0], p[3], p[1]) for p in places if any((q[0], q[1]) < (p[0], p[1]) and brute.within_one(p[2], q[2]) for q in places)}
    for r in line_dedup.dedup_lines(docs).collect():
        lines = (r.text or "").split("\n")
        want = [n for n in range(len(lines)) if ((r.doc_id is not None, r.doc_id or 0), r.text, n) in gone]
        assert r.dedup.removed == (want if r.text is not None else [])
        assert r.dedup.text == (None if r.text is None else "\n".join(x for n, x in enumerate(lines) if n not in want))


def test_line_dedup_edits(spark):
    line = "one two three four five six seven"
    texts = [line, line.upper(), line.replace("four", "for"), line.replace("four ", ""), line + " eight", "zero " + line, line.replace("two", "2").replace("six", "6"), "one two three", "one two three"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.dedup.removed for r in line_dedup.dedup_lines(docs).collect()}
    assert [i for i in got if got[i]] and sorted(i for i in got if got[i]) == [1, 2, 3, 4, 5]


def test_near_components(docs, rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    sets = [brute.shingles(brute.words(rows[i][1])) for i in order]
    roots = brute.components(sets, 85)
    want = [(rows[i][0], len(s), rows[order[r]][0] if s else rows[i][0]) for i, s, r in zip(order, sets, roots, strict=True)]
    got = by_text(minhash.report(docs), "doc_id", "n_shingles", "component_id")
    assert got == sorted(want, key=str)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(w[0]) for w in want if w[0] == w[2]})


def test_components_of_long_chains(spark):
    ws = Workspace(spark, "test")
    links = spark.range(1, 300).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v")).unionByName(spark.createDataFrame([(1000, 999), (998, 999)], "u long, v long"))
    roots = {r.node: r.root for r in near.components(ws, links, "x").collect()}
    assert all(roots[i] == 0 for i in range(1, 300)) and roots[1000] == roots[999] == 998


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(1)
    unary, trans = rng.normal(size=(1, 4, 2)), rng.normal(size=(2, 2))
    weights = {}
    for path in np.ndindex(2, 2, 2, 2):
        weights[path] = np.exp(sum(unary[0, t, path[t]] for t in range(4)) + sum(trans[path[t], path[t + 1]] for t in range(3)))
    z = sum(weights.values())
    p, moves = crf_quality.marginals(unary, trans, np.array([4]))
    for t in range(4):
        assert np.isclose(p[0, t, 1], sum(w for k, w in weights.items() if k[t] == 1) / z)
    assert np.isclose(moves[0, 0, 1], sum(w * sum(k[t] == 0 and k[t + 1] == 1 for t in range(3)) for k, w in weights.items()) / z)


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = crf_quality.report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_quality_of_odd_texts(docs):
    labels = docs.sparkSession.createDataFrame([(r, int(r % 14 == 0), 0) for r in range(100)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in crf_quality.report(docs, labels).collect()}
    blank = [r.doc_id for r in docs.where("text is null or text rlike '^\\\\s*$'").collect()]
    assert len(blank) == 3 and all(got[i].score == 0 for i in blank)
    assert crf_quality.accept(docs, labels).columns == docs.columns


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.report(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97


def test_language_of_odd_texts(spark, docs):
    got = {r.doc_id: r for r in langid.report(docs).collect()}
    assert {r.lang_pred for r in got.values()} == {"und", "en"}
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "word")], "doc_id long, text string")
    model = langid.train(spark.read.parquet(f"{DATA}/documents.parquet"))
    got = {r.doc_id: r.language for r in langid.identify(odd, model).collect()}
    assert [got[i].lang for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang != "und"


def test_image_copies(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=64).tolist()) for i in range(40)] + [(41, None), (42, []), (43, [1.0] * 64), (44, [None] * 3 + [2.0]), (None, rng.normal(size=64).tolist())]
    vectors.append((50, vectors[0][1]))
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    drawn = media.render(table, edits=(0, 1, 2))  # cropped, turned by a quarter, painted over
    got = {r.image_id: r.class_id for r in media.copy_classes(drawn).collect() if r.image_id is not None}
    assert np.mean([got[2 * i] == got[2 * i + 1] == 2 * i for i in range(40)]) >= 0.95
    assert got[100] == got[0]
    assert len({got[2 * i] for i in range(40)}) == 40


def drawn(n):
    return [np.random.default_rng(i).integers(0, 256, (8, 8)).astype(np.uint8).repeat(6, 0).repeat(6, 1) for i in range(n)]


def test_harder_edits_of_images():
    """Blurred, resized and freely turned copies: the comparison takes them all, the tables meet most of the first two."""
    images = drawn(120)
    found = media.describe(np.stack(images))
    for kind, least in ((3, 0.95), (4, 0.5), (5, 0.05)):
        copies = media.describe(np.stack([media.edited(x, kind) for x in images]))
        assert np.mean([media.agree(a, b) for a, b in zip(found, copies, strict=True)]) >= 0.95
        assert np.mean([len(np.intersect1d(media.table_keys(*a), media.table_keys(*b))) > 0 for a, b in zip(found, copies, strict=True)]) >= least
    assert not any(media.agree(a, b) for a, b in zip(found, found[1:]))


def _as_rows(found, first=0):
    return [(first + i, p.astype("<f4").tobytes(), c.tobytes()) for i, (p, c) in enumerate(found)]


def test_shared_keys_of_images_go_packed(spark, monkeypatch):
    """What images share a key is the same as by the plain keys, and a key is shipped in ``PACKED`` bytes."""
    images = drawn(60)
    found = media.describe(np.stack(images + [media.edited(x, 1) for x in images] + [media.edited(x, 3) for x in images[:30]]))
    found += [found[0]] * media.FEW
    found.append((np.empty((0, 4)), np.empty((0, media.BITS // 8), np.uint8)))
    rows = _as_rows(found[:70], 3) + _as_rows(found[70:], (1 << 33) + 5)  # as of two files
    plain = {}
    for num, *x in rows:
        for k in media.table_keys(*media._read(*x)).tolist():
            plain.setdefault(k, set()).add(num)
    few = [sorted(x) for x in plain.values() if len(x) <= media.FEW]
    want = {(x[i], x[j]) for x in few for j in range(len(x)) for i in range(j)}, sorted(tuple(sorted(x)) for x in plain.values() if len(x) > media.FEW)
    table = spark.createDataFrame(rows, "num long, set binary, sig binary").coalesce(1)
    for buckets, chunk in ((1, 1 << 20), (7, 3000)):
        monkeypatch.setattr(media, "CHUNK_KEYS", chunk)
        sent = pa.Table.from_batches(list(media._pack(buckets)(table.toArrow().to_batches())))
        packed = sum(len(x) for c in ("low", "high", "own") for x in sent.column(c).to_pylist())
        assert packed == media.PACKED * sum(map(len, plain.values()))
        assert sent.num_rows <= buckets * 2 * (1 + packed // media.PACKED // chunk)
        pairs, more = set(), {}
        for k in set(sent.column("bucket").to_pylist()):
            for bucket, u, v in zip(*media._meet(sent.filter(pc.equal(sent.column("bucket"), k))).to_pydict().values(), strict=True):
                if bucket is None:
                    pairs.add((u, v))
                else:
                    more.setdefault(bucket, []).append(u)
        assert (pairs, sorted(tuple(sorted(x)) for x in more.values())) == want and pairs and more


def test_image_pairs_by_cells(spark, monkeypatch):
    """Every pair is compared in one cell, whatever the number of groups, and a slice ships an image twice at most."""
    images = drawn(12)
    found = media.describe(np.stack(images + images[::-1]))
    sets = spark.createDataFrame([(7 * num - 30, num, p, c) for num, p, c in _as_rows(found)], "node long, key long, set binary, sig binary").cache()
    pairs = [(7 * i - 30, 7 * j - 30) for i in range(24) for j in range(i + 1, 24)]
    want = {(7 * i - 30, 7 * j - 30) for i in range(24) for j in range(i + 1, 24) if media.agree(found[i], found[j])}
    assert len(want) == 12
    shipped = []
    save = media.Workspace.save

    def saved(ws, df, name):
        shipped.append(name)
        return save(ws, df, name)

    monkeypatch.setattr(media.Workspace, "save", saved)
    for groups in (1, 2, 3, 6):
        monkeypatch.setattr(media, "CELL_PAIRS", len(pairs) / groups**2)
        shipped.clear()
        got = media._in_cells(media.Workspace(spark, "cells"), 24, 48)(spark.createDataFrame(pairs, "u long, v long"), sets, 0).collect()
        assert sorted((r.u, r.v) for r in got) == sorted(want) and all(r.linked for r in got)
        assert sum(x.startswith("agree") for x in shipped) == groups // 2 + 1
    few = media._in_cells(media.Workspace(spark, "cells"), 24, 48)(spark.createDataFrame([min(want)], "u long, v long"), sets, 0).collect()
    assert [(r.u, r.v) for r in few] == [min(want)]
    assert not media._in_cells(media.Workspace(spark, "cells"), 24, 48)(spark.createDataFrame([], "u long, v long"), sets, 0).collect()


def test_consensus_against_each_pair(monkeypatch):
    images = drawn(4)
    turned = [np.rot90(images[0]), images[1][4:-3, 3:-4], images[3]]
    for a, b in zip(media.describe(np.stack(images[:3])), [media.describe(x[None])[0] for x in turned], strict=True):
        bits_a, bits_b = (np.unpackbits(x[1], axis=1).astype(int) for x in (a, b))
        far = [[int((x != y).sum()) for y in bits_b] for x in bits_a]
        pairs = []
        for i, row in enumerate(far):
            j = row.index(min(row))
            column = [r[j] for r in far]
            if row[j] <= media.NEAR and column.index(min(column)) == i:
                pairs.append((i, j))
        want = 0
        for i, j in pairs:
            ratio, turn = b[0][j, 2] / a[0][i, 2], b[0][j, 3] - a[0][i, 3]
            move = ratio * np.array([[np.cos(turn), np.sin(turn)], [-np.sin(turn), np.cos(turn)]])
            want = max(want, sum(np.hypot(*(move @ (a[0][m, :2] - a[0][i, :2]) - (b[0][n, :2] - b[0][j, :2]))) <= media.MISS for m, n in pairs))
        want = want if len(pairs) >= media.AGREE else 0
        for block in (media.BLOCK, 7):
            monkeypatch.setattr(media, "BLOCK", block)
            assert media.consensus(a, b) == want


def test_images_with_very_many_corners():
    rng = np.random.default_rng(5)
    image = rng.integers(0, 256, (320, 320)).astype(np.uint8)
    (a,), (b,) = media.describe(image[None]), media.describe(image[None, 20:, 30:])
    assert len(a[0]) > 5000 and media.agree(a, b)
    assert len(np.intersect1d(media.table_keys(*a), media.table_keys(*b))) > 100


def test_table_keys_against_each_point():
    rng = np.random.default_rng(4)
    points, codes = rng.random((300, 4)) * 6, rng.integers(0, 256, (300, media.BITS // 8), dtype=np.uint8)
    points[:, 2] = rng.integers(1, 3, 300)
    bits, want = np.unpackbits(codes, axis=1), set()
    number = lambda i, t: sum(int(x) << k for k, x in enumerate(bits[i, t * media.WIDTH : (t + 1) * media.WIDTH]))
    hashed = lambda x: int(media.mix(np.array([x % 2**64], np.uint64))[0])
    step = 2 * np.pi / media.TURNS
    for i in range(300):
        same = [j for j in range(300) if j != i and points[j, 2] == points[i, 2]]
        near_by = sorted(same, key=lambda j: (((points[i, :2] - points[j, :2]) ** 2).sum(), j))[: media.NEIGHBOURS]
        for t in range(media.TABLES):
            seen = []
            for j in near_by:
                dy, dx = points[j, :2] - points[i, :2]
                lies, turned = (round(float(x) / step) % media.TURNS for x in (np.arctan2(dy, dx) - points[i, 3], points[j, 3] - points[i, 3]))
                seen.append(hashed(number(j, t) * media.TURNS**2 + lies * media.TURNS + turned))
            own = hashed(number(i, t) * media.TABLES + t)
            want |= {hashed(own + 3 * (x + y)) for n, x in enumerate(seen) for y in seen[:n]}
    got = media.table_keys(points, codes)
    assert set(got.view(np.uint64).tolist()) == want
    assert not len(media.table_keys(points[:2], codes[:2])) and not len(media.table_keys(points[:0], codes[:0]))


def test_pipeline_on_odd_rows(spark, docs, tmp_path):
    spark.createDataFrame([(r, int(r % 9 > 0), 0) for r in range(101)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "fan fan fan")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, str(tmp_path))
        if name != "tokens":
            assert out.columns == table.columns
        stage(spark, table.limit(0), str(tmp_path)).collect()
        out.write.parquet(f"{tmp_path}/{name}")
        table = spark.read.parquet(f"{tmp_path}/{name}")
    assert "ids" in table.columns


def test_pipeline_stages_decide(spark):
    """Each stage against what its operator reports on the same input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    good = {r.doc_id for r in crf_quality.report(docs, labels).collect() if r.predicted}
    first = corpus_pipeline.quality(spark, docs, DATA)
    assert {r.doc_id for r in first.collect()} == good
    clean = {r.doc_id for r in decontaminate.report(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect() if not r.contaminated}
    assert {r.doc_id for r in corpus_pipeline.benchmark(spark, docs, DATA).collect()} == clean
    tokenizer = bpe.load(queries.tokenizer_path())
    for r in corpus_pipeline.tokens(spark, docs, DATA).join(docs.select("doc_id", "text"), "doc_id").collect():
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids
        assert bytes(r.ids) == np.array(ids, "<u4").tobytes() and r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
