"""Pipeline stages on what an operator's own query leaves out."""

import random
from types import SimpleNamespace

import duckdb
import pytest

import corpus_pipeline
from tests.llm import brute
from tidewheel.llm import line_dedup, queries
from tidewheel.llm.common import shared_root

DATA = "/root/testdata/sf0.001"


def changed(base, at):
    return [f"new{k}" if k in at else w for k, w in enumerate(base)]


def test_pipeline_near_links_from_four_fifths(spark):
    """Pairs on both sides of 0.80 and 0.85, against brute force."""
    rng, texts = random.Random(5), []
    for group in range(12):
        base = [f"g{group}w{rng.randrange(10**6)}" for _ in range(200)]
        texts += [" ".join(base), " ".join(changed(base, {k * 200 // (group + 1) + 6 for k in range(group + 1)}))]
    sets = [brute.shingles(brute.words(t)) for t in texts]
    ratios = [100 * len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert any(80 <= x < 85 for x in ratios) and any(75 < x < 80 for x in ratios) and any(x > 85 for x in ratios)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i for i, root in enumerate(brute.components(sets, 80)) if root == i}
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()} == want


def test_pipeline_lines_compare_every_line(spark):
    """Short lines go if equal only, lines of six words or more if within a word, blank ones never; against brute force."""
    long = "one two three four five six seven"
    texts = ["Released under the MIT License.\n\n版权所有\nall rights", f"released UNDER the  MIT License.\n \n{long}", f"版权所有\n\nReleased under the BSD License.\n{long} eight\nall rights\nx", "x\nX", "alpha beta gamma delta eps", "alpha beta gamma delta eps zeta", None]
    gone, earlier = {}, []
    for i, t in enumerate(texts):
        for n, line in enumerate((t or "").split("\n")):
            ws = brute.words(line)
            if any(ws == e or min(len(ws), len(e)) >= 6 and brute.within_one(ws, e) for e in earlier):
                gone.setdefault(i, set()).add(n)
            if ws:
                earlier.append(ws)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, ())) for i, t in enumerate(texts)}
    assert gone == {1: {0}, 2: {0, 3, 4}, 3: {0, 1}}
    want.pop(3)  # nothing of it is left
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()} == want


def test_pipeline_leaves_no_emptied_copies(spark):
    """Copies, upper-cased copies and copies with a word changed in each line go; blank and null texts aren't made by it."""
    rng = random.Random(6)
    lines = [" ".join(f"w{rng.randrange(10**5)}" for _ in range(12)) for _ in range(5)]
    near = [" ".join(["new", *x.split(" ")[1:]]) for x in lines]
    texts = ["\n".join(lines), "\n".join(lines).upper(), "\n".join(near), "\n\n".join(reversed(lines)), "\n".join([*lines, "a line of its own that stays"]), "", None, " \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert got == {0: texts[0], 4: "a line of its own that stays", 5: "", 6: None, 7: " \n"}


def test_every_line_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    columns = ["doc_id", "n_lines", "n_removed", "kept_sha256"]
    got = line_dedup.report(spark.read.parquet(f"{DATA}/documents.parquet"))
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(con.execute(queries.OP5_SQL).fetchall())


def test_no_machine_local_work_on_a_cluster():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(session)
