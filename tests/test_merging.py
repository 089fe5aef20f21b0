import json
import random

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import merging, pages


def fold(rows, lists):
    """Objects merged one after another."""
    out = None
    for row in rows:
        if out is None:
            out = dict(row)
            continue
        for k, v in row.items():
            if k in lists:
                out[k] = list({json.dumps(x): x for x in [*(out.get(k) or []), *(v or [])]}.values())
            elif v not in (None, "", [], {}):
                if not (isinstance(out.get(k), str) and isinstance(v, str) and len(out[k]) > len(v)):
                    out[k] = v
    return out


def test_records_of_any_shape_merge_as_a_fold(spark):
    rng = random.Random(6)
    values = ["", "a", "bb", "cc", "ddd", None, 0, 5, 2.5, True, False, [], [1], ["x"], {}, {"a": 1}, "é\"\n"]
    rows, want = [], {}
    for k in range(60):
        objects = []
        for n in range(rng.randrange(1, 6)):
            obj = {f: rng.choice(values) for f in ("t", "u", "w\"x") if rng.random() < 0.8}
            if rng.random() < 0.7:
                obj["locations"] = rng.choice([[], ["Pune"], ["Pune", "Agra"], ["Agra", {"a": 1}, "Agra"]])
            objects.append(obj)
            rows.append((k, n, json.dumps(obj)))
        want[k] = fold(objects, ["locations"])
    rows += [(7, 99, "{broken"), (7, 98, None), (7, 97, "[1]")]
    rng.shuffle(rows)
    got = {r.k: json.loads(r.body) for r in merging.merge_records(spark.createDataFrame(rows, "k int, n int, body string"), ["k"], "n", "body", ["locations"]).collect()}
    once = {k for k in want if sum(1 for r in rows if r[0] == k and r[2] and "locations" in json.loads(r[2] if r[2][0] == "{" and r[2][1] != "b" else "{}")) == 1}
    for k, v in want.items():  # a list that came once stays as it was
        if k not in once and "locations" in v:
            v["locations"] = list({json.dumps(x): x for x in v["locations"]}.values())
    assert got == want


def test_columns_of_passes(spark):
    rows = [("a", 1, ["x", "y"], "long text", 1), ("a", 2, None, "text long", None), ("a", 3, ["z", "x"], "short", 3), ("b", 1, [], None, None), ("b", 2, ["q"], "", None)]
    table = spark.createDataFrame(rows, "k string, n int, tags array<string>, t string, v int")
    got = {r.k: tuple(r)[1:] for r in merging.merge_passes(table, ["k"], "n", ["tags"], ["t"], ["v"]).collect()}
    assert got == {"a": (["x", "y", "z"], "text long", 3, 3), "b": (["q"], None, None, 2)}


def test_hydration(spark):
    rows = spark.createDataFrame([("1", "t1", None, "IN"), ("2", "t2", " ", "IN"), ("3", "t3", None, "IN"), ("4", "t4", "has", "IN"), ("5", "t5", None, "US")], "id string, title string, description string, country string")
    detail = spark.createDataFrame([("1", "D1", "from detail"), ("2", "D2", None), ("4", "D4", "x"), ("5", "D5", "x")], "id string, title string, description string")
    public = spark.createDataFrame([("1", "page"), ("2", "page 2"), ("2", "page 2"), ("9", "z")], "id string, description string")
    found = merging.hydrate(rows, detail, public, ["id"], F.col("country") == "IN", ["title", "description"])
    assert {r.id: tuple(r)[1:] for r in found.collect()} == {
        "1": ("D1", "from detail", "IN", True, "position_details"), "2": ("D2", "page 2", "IN", True, "public_job_page"), "3": ("t3", None, "IN", False, "missing"), "4": ("t4", "has", "IN", None, None), "5": ("t5", None, "US", None, None),
    }


def test_details_by_jsonld_or_main_text(spark):
    html = ['<script type="application/ld+json">{"@type": "JobPosting", "title": "Cook", "description": "<b>d</b>"}</script><main>m</main>', "<nav>n</nav><main>The <b>main</b> part</main><article>no</article>", "<article>An article</article>", "<p>none</p>"]
    table = spark.createDataFrame([(i, f"https://h/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    listed = spark.createDataFrame([(f"r{i}", i, f"L{i}", f"https://h/{i}") for i in range(5)], "record_id string, page_id long, title string, url string")
    got = {r.record_id: (r.title, r.description, r.source) for r in merging.supplement_details(listed, pages.jsonld(table), pages.main_text(table)).collect()}
    assert got == {"r0": ("Cook", "d", "jsonld"), "r1": ("L1", "The main part", "main_text"), "r2": ("L2", "An article", "main_text"), "r3": ("L3", None, "listing"), "r4": ("L4", None, "listing")}


def test_attempts_and_overlays(spark):
    tries = spark.createDataFrame([("a", 1, 0), ("a", 2, 3), ("a", 3, 5), ("a", 4, 5), ("b", 1, 0), ("b", 2, 0)], "k string, attempt int, rows int")
    pick = lambda mode: {r.k: r.attempt for r in merging.best_attempt(tries, ["k"], mode).collect()}
    assert pick("first") == {"a": 2, "b": 1} and pick("longest") == {"a": 3, "b": 1}
    with pytest.raises(ValueError):
        pick("other")
    one, two = (spark.createDataFrame(r, "k int, t string, n int") for r in ([(1, "", 4), (2, "x", None)], [(1, "y", 5), (3, "z", None)]))
    got = {r.k: tuple(r)[1:] for r in merging.overlay([("one", one), ("two", two)], ["k"], ["t", "n"]).collect()}
    assert got == {1: ("y", "two", 4, "one"), 2: ("x", "one", None, None), 3: ("z", "two", None, None)}
