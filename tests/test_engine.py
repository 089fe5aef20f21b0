"""The posting engine on inline rows: boundaries that the given tables don't reach."""

import json

import pytest
from pyspark.sql import functions as F

from tidewheel.functions import predicates as R
from tidewheel.functions import text as T
from tidewheel.operators import extract, gate, health, inventory, location, neardup, relevance
from tidewheel.streaming import merge as streaming


def values(spark, rows, schema, **columns):
    out = spark.createDataFrame(rows, schema).select("k", *(c.alias(n) for n, c in columns.items()))
    return {r.k: r for r in out.collect()}


@pytest.mark.parametrize(
    ("place", "status", "normalized"),
    [
        ("Bengaluru, India / London, UK", "india", "Bengaluru, India"),
        ("Hyderabad, Pakistan", "foreign", "Hyderabad, Pakistan"),
        ("Navi Mumbai", "india", "Navi Mumbai, India"),
        ("Greater Noida", "india", "Greater Noida, India"),
        ("Remote, IN", "india", "Remote, India"),
        ("IN", "india", "India"),
        ("in", "india", "India"),
        ("BLR-04", "india", "Bengaluru, India"),
        ("blr-04", "unknown", "blr-04"),
        ("Orissa", "india", "Odisha, India"),
        ("Kharadi", "india", "Pune, India"),
        ("Remote - US", "unknown", "Remote - US"),
        ("Indianapolis", "unknown", "Indianapolis"),
        (None, "unknown", "Unknown"),
        ("  ", "unknown", "Unknown"),
    ],
)
def test_location_text(spark, place, status, normalized):
    row = location.classify(spark.createDataFrame([(place, "no evidence here")], "location string, description string")).first()
    assert (row.location_status, row.location_normalized) == (status, normalized)


def test_location_description(spark):
    rows = [("a", "Job location: Berlin, Germany\nWork location - Pune"), ("b", "This role is remote within India."), ("c", "Our team in India is great"), ("d", None)]
    df = spark.createDataFrame([(k, "Anywhere", d) for k, d in rows], "k string, location string, description string")
    got = {r.k: (r.location_status, r.location_normalized) for r in location.classify(df).collect()}
    assert got == {"a": ("india", "Pune, India"), "b": ("india", "Remote, India"), "c": ("unknown", "Anywhere"), "d": ("unknown", "Anywhere")}


def test_location_structured(spark):
    payloads = {
        "several": {"allowedCountries": [{"countryCode": "US"}, {"countryCode": "IN"}]},
        "foreign": {"primaryLocation": {"city": "Bengaluru", "country": "Poland"}},
        "code": {"job": {"countryCode": "ANY"}},
        "state": {"primaryLocation": {"region": "KA", "city": "Somewhere"}},
        "list": {"locations": ["Pune"]},
        "bad": None,
    }
    rows = [(k, json.dumps(v) if v else "{not json") for k, v in payloads.items()]
    found = location.structured_evidence(location.structured_values(spark.createDataFrame(rows, "key string, raw string"), "key", "raw"))
    got = {r.key: (r.country_status, r.place) for r in found.collect()}
    assert got == {"several": ("india", None), "foreign": ("foreign", "Bengaluru"), "code": ("foreign", None), "state": (None, "Karnataka")}
    both = spark.createDataFrame([("foreign", "Pune", "")], "key string, location string, description string").join(found, "key")
    assert location.classify(both, structured=True).first().location_status == "foreign"


def test_experience(spark):
    rows = [(1, "3-5 years"), (2, "5 to 3 yrs"), (3, "2+ years and 10 years"), (4, "30 years"), (5, "none"), (6, "1.5 years"), (7, "8–10 years"), (8, "115 years")]
    got = values(spark, rows, "k int, t string", m=F.array_min(relevance.experience_mentions(F.col("t"))))
    assert [(got[k].m.low, got[k].m.high) if got[k].m else None for k in range(1, 9)] == [(3, 5), (3, 5), (2, None), None, None, (1.5, None), (8, 10), None]


def test_experience_points(spark):
    cases = [(None, None, 18), (8, None, 0), (3, 5, 20), (2, None, 20), (1, 4, 14), (1, 3, 8), (0, 2, 5), (6, None, 12), (7, None, 5), (1, None, 12)]
    rows = [(i, None if a is None else float(a), None if b is None else float(b)) for i, (a, b, _) in enumerate(cases)]
    got = values(spark, rows, "k int, a double, b double", p=relevance.experience_points(F.col("a"), F.col("b")))
    assert [got[i].p for i in range(len(cases))] == [float(x[2]) for x in cases]


def test_section_is_closed_by_a_short_line_but_not_by_the_first(spark):
    text = "Intro\nRequirements:\nJava Spring Boot backend\nmore: 1, 2\nAbout us\nnothing"
    row = relevance.with_sections(spark.createDataFrame([(text,)], "t string"), "t", {"s": ["requirements"]}).first()
    assert row.s == "Java Spring Boot backend\nmore: 1, 2"


def test_aliases_have_boundaries_only_if_short(spark):
    got = values(spark, [(1, "javascript"), (2, "java"), (3, "reactive"), (4, "sqlite"), (5, "c sql")], "k int, t string", java=T.contains_alias(F.col("t"), "java"), react=T.contains_alias(F.col("t"), "react"), sql=T.contains_alias(F.col("t"), "sql"))
    assert [got[k].java for k in range(1, 6)] == [False, True, False, False, False]
    assert got[3].react and not got[4].sql and got[5].sql


def test_plausible(spark):
    rows = [
        (1, "Support", "greenhouse", None, True), (2, "Products", "generic_html", "https://x.com/products", False), (3, "Apply now", "lever2", "https://x.com/jobs/12", False),
        (4, "Baker", "generic_html", "https://x.com/jobs/12", True), (5, "Baker", "generic_html", "https://x.com/jobs/search", False), (6, "Privacy Engineer", "browser_html", None, True),
        (7, "  ", "greenhouse", None, False), (8, "Baker", "custom_api", None, True), (9, "Baker", "generic_html", "https://x.com/a?gh_jid=3", True),
    ]
    got = values(spark, [r[:4] for r in rows], "k int, t string, s string, u string", ok=R.plausible(F.col("t"), F.col("s"), F.col("u")))
    assert {k: got[k].ok for k in got} == {r[0]: r[4] for r in rows}


GATE = "company_id string, external_id string, title string, location string, description string, job_url string, source_type string, ord int"


def test_gate(spark):
    rows = [
        ("c", "7", "Data Engineer", "Pune", None, "https://x.com/jobs/7", "custom", 1),
        ("c", "7", "Data Engineer again", None, None, None, "custom", 2),  # fragment of a usable id
        ("c", None, "data engineer", "PUNE", None, None, "custom", 3),  # fragment by title and place
        ("c", "https://x.com/jobs/8", "Analyst", None, None, None, "custom", 4),  # repaired
        ("c", None, "Writer", None, None, None, "custom", 5),
        ("c", None, "Painter", None, None, None, "custom", 6),  # shares the key of rows without any
        ("c", "9", "Baker", None, None, "https://x.com/jobs/7", "custom", 7),  # same URL
        ("d", "1", "Baker", None, None, None, "custom", 8),
    ]
    got = {r.ord: r for r in gate.gate(spark.createDataFrame(rows, GATE)).collect()}
    assert sorted(got) == [1, 4, 5, 8]
    assert got[4].job_url == "https://x.com/jobs/8" and got[4].repaired_url


STATE = "company_id string, external_id string, content_hash string, first_seen int, last_seen int, changed_at int, active boolean, last_change_type string"
SNAP = "company_id string, external_id string, content_hash string"


def test_merge_lifecycle(spark):
    state = spark.createDataFrame([], STATE)
    runs = [[("c", "a", "1"), ("c", "b", "1")], [("c", "a", "2")], [("c", "a", "2"), ("c", "b", "1")]]
    complete = spark.createDataFrame([("c", True)], "company_id string, complete boolean")
    seen = []
    for i, rows in enumerate(runs):
        state = inventory.merge(state, spark.createDataFrame(rows, SNAP), F.lit(i), complete)
        seen.append({r.external_id: (r.active, r.last_change_type, r.first_seen, r.changed_at) for r in state.collect()})
        state = spark.createDataFrame(state.collect(), STATE)
    assert seen[1] == {"a": (True, "changed", 0, 1), "b": (False, "new", 0, 0)}
    assert seen[2] == {"a": (True, "unchanged", 0, 1), "b": (True, "unchanged", 0, 0)}
    again = inventory.merge(state, spark.createDataFrame(runs[2], SNAP), F.lit(9), complete)
    assert {r.last_change_type for r in again.collect()} == {"unchanged"}
    partial = inventory.merge(state, spark.createDataFrame([("c", "a", "2")], SNAP), F.lit(9), None)
    assert all(r.active for r in partial.collect())


def test_completeness_valve(spark):
    rows = [(1, 10, 100, False), (2, 20, 100, False), (3, 0, 100, False), (4, 0, 100, True), (5, 5, None, False)]
    got = values(spark, rows, "k int, n int, p int, z boolean", ok=inventory.completeness(F.col("n"), F.col("p"), F.col("z")))
    assert [got[k].ok for k in range(1, 6)] == [False, True, False, True, True]


def test_events_closed_only_if_complete(spark):
    before = spark.createDataFrame([("c", "a", "1"), ("c", "b", "1"), ("d", "z", "1")], SNAP)
    now = spark.createDataFrame([("c", "a", "2"), ("c", "n", "1")], SNAP)
    complete = spark.createDataFrame([("c", True), ("d", False)], "company_id string, complete boolean")
    got = {r.external_id: r.event for r in inventory.run_events(before, now, complete).collect()}
    assert got == {"a": "changed", "n": "new", "b": "closed"}


def test_replay_does_not_depend_on_order_or_partitions(spark):
    rows = [(r, "c", str(k), str((k * r) % 3)) for r in range(6) for k in range(8) if (k + r) % 4]
    df = spark.createDataFrame(rows, "run int, company_id string, external_id string, content string")
    want = sorted(map(tuple, inventory.replay(df).collect()))
    assert sorted(map(tuple, inventory.replay(df.orderBy(F.rand(3)).repartition(7)).collect())) == want


def test_health(spark):
    rows = [(1, 0, 5, 1.0, 200), (2, 100, 100, 0.8, 200), (3, 10, 100, 1.0, 200), (4, 100, 100, 1.0, 403), (5, 100, 100, 1.0, 404), (6, 100, None, 1.0, None)]
    status = health.health(F.col("n"), F.col("p"), F.col("q"), F.lit(False), F.col("d"), F.lit(False), F.lit(None).cast("string"))
    got = values(spark, rows, "k int, n int, p int, q double, d int", h=status)
    assert [(got[k].h.status, got[k].h.category) for k in range(1, 7)] == [
        ("failed", "zero_jobs_detected"), ("suspicious", "low_job_record_quality"), ("suspicious", "large_job_count_drop"),
        ("healthy_with_fallback", "sample_detail_access_restricted"), ("suspicious", "sample_job_detail_unreachable"), ("healthy", None),
    ]


def test_even_sample(spark):
    rows = spark.createDataFrame([("c", i) for i in range(12)] + [("d", 0), ("d", 1)], "company_id string, ord int")
    pick = lambda n: sorted((r.company_id, r.ord) for r in gate.even_sample(rows, n).collect())
    assert pick(3) == [("c", 0), ("c", 6), ("c", 11), ("d", 0), ("d", 1)]
    assert pick(1) == [("c", 6), ("d", 1)] and pick(0) == []


def test_near_duplicates_are_not_closed_transitively(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [words, words[20:] + [f"x{i}" for i in range(10)], words[40:] + [f"x{i}" for i in range(20)]]
    rows = [(str(i), "b", " ".join(t), i) for i, t in enumerate(texts)]
    got = {r.key: r.canonical for r in neardup.mark(spark.createDataFrame(rows, "k string, block string, text string, o int"), "block", "k", "text", ["o"]).collect()}
    assert got == {"0": None, "1": "0", "2": None}


PAGE = """<html><script type="application/ld+json">{"title": "Data Engineer", "id": 5}</script><script>x</script>
<div><h3>Backend Engineer</h3><p>Pune</p><a href="/jobs/12">Apply now</a></div><p>Remote Data Analyst <a href="//y.com/job/3">Data Analyst</a></p>
<a href="mailto:a@b.c">Engineer</a><a href="/careers">Careers</a><a href="/jobs/12">Backend Engineer</a><a href="/search-results">Search jobs</a></html>"""


def test_page_harvest(spark):
    pages = spark.createDataFrame([(1, "https://x.com/a/", PAGE), (2, "https://x.com", None), (3, None, "<a href='::'>Engineer")], "page_id long, url string, html string")
    got = {r.job_url: r for r in extract.harvest_links(pages).where("page_id = 1").collect()}
    assert got["https://x.com/jobs/12"].title == "Backend Engineer"
    assert got["https://y.com/job/3"].location == "Remote"
    bare = spark.createDataFrame([(4, "https://x.com/", '<a href="/careers">Careers</a><a href="/blog">News</a><a href="/job/4">Baker</a>')], "page_id long, url string, html string")
    assert [r.job_url for r in extract.harvest_links(bare).collect()] == ["https://x.com/job/4"]
    assert [r.target for r in extract.listing_links(pages).collect()][0] == "https://x.com/search-results"
    state = extract.embedded_json(pages)
    assert [r.title for r in extract.harvest_json(state, "page_id", "body").collect()] == ["Data Engineer"]


def test_nested_json(spark):
    body = json.dumps({"a": [{"jobTitle": "QA Lead", "reqId": 3, "locations": [{"city": "Pune", "country": "India"}], "description": "<b>x</b> y"}, {"name": "not a job"}]})
    row = extract.harvest_json(spark.createDataFrame([("p", body), ("q", "{"), ("r", None)], "k string, b string"), "k", "b").collect()
    assert [(r.title, r.external_id, r.location, r.description) for r in row] == [("QA Lead", "3", "Pune, India", "x y")]


def test_streaming_merge_equals_batch(spark, tmp_path):
    schema = "run int, company_id string, external_id string, content string"
    runs = [[(0, "c", "a", "1"), (0, "c", "b", "1")], [(1, "c", "a", "2")], [(2, "c", "a", "2"), (2, "c", "b", "1")]]
    for rows in runs:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        streaming.start(spark, f"{tmp_path}/in", schema, f"{tmp_path}/state", f"{tmp_path}/cp").awaitTermination()
    got = {r.external_id: (r.active, r.last_change_type, r.first_seen, r.changed_at) for r in streaming.state(spark, f"{tmp_path}/state").collect()}
    assert got == {"a": (True, "unchanged", "0", "1"), "b": (True, "unchanged", "0", "0")}
