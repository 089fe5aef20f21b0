import json

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import boards, health, inventory, pages, relevance, runs
from tidewheel.sources import landing


def config(spark, *rows):
    return spark.createDataFrame([(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(rows, 1)], "ord long, body string")


def errors(spark, *rows):
    return [r.error for r in boards.config_errors(config(spark, *rows)).orderBy("ord", "place").collect()]


GOOD = {"id": "a", "name": "A", "career_url": "https://a", "source": {"type": "auto"}, "rank": 1, "enabled": False}


def test_config_errors(spark):
    assert errors(spark, GOOD) == []
    assert errors(spark, GOOD, GOOD | {"name": "B"}, GOOD) == ["duplicate id: a", "duplicate rank: 1"] * 2
    assert errors(spark, {}) == ["row 1: missing id", "row 1: missing name", "row 1: missing career_url", "row 1: missing source", "row 1: unsupported source type None"]
    assert errors(spark, "{", None) == [e.replace("row 1", f"row {i}") for i in (1, 2) for e in errors(spark, {})]
    assert errors(spark, {}, {}).count("duplicate id: ") == 0
    assert errors(spark, GOOD | {"rank": 0}, GOOD | {"id": "b", "rank": 1.5}, GOOD | {"id": "c", "rank": None}) == ["a: rank must be a positive integer", "b: rank must be a positive integer"]
    assert errors(spark, GOOD | {"enabled": 1}, GOOD | {"id": "b", "rank": 2, "enabled": None}) == ["a: enabled must be true/false", "b: enabled must be true/false"]
    assert errors(spark, GOOD | {"source": "auto"}) == ["a: unsupported source type None"]
    assert errors(spark, GOOD | {"source": {"type": "custom_api", "endpoint": "e", "field_mapping": {}}}) == ["a: source custom_api requires field_mapping"]
    assert errors(spark, GOOD | {"career_url": "ftp://a"}) == ["a: invalid career_url"]
    assert boards.config_errors(config(spark).limit(0)).collect() == []


def test_company_state(spark):
    companies = spark.createDataFrame([("a", True), ("b", None), ("c", False), ("d", True)], "company_id string, enabled boolean")
    postings = spark.createDataFrame([("a", True), ("a", False), ("z", True)], "company_id string, active boolean")
    rows = [("a", "verify", "r1", "1", "failed"), ("a", "verify", "r3", "2", "healthy"), ("a", "verify", "r2", "2", "suspicious"), ("a", "fetch", "r9", "3", "failed"), ("b", "fetch", "r9", "3", "healthy"), ("c", "verify", "r1", "1", "healthy")]
    results = spark.createDataFrame(rows, "company_id string, run_type string, run_id string, created_at string, status string")
    got = {r.company_id: r for r in boards.company_state(companies, postings, results).collect()}
    assert {k: r.resolved_health for k, r in got.items()} == {"a": "healthy", "b": "never_verified", "c": "disabled", "d": "never_verified"}
    assert (got["a"].active_jobs, got["a"].total_jobs, got["a"].fetch_result.run_id, got["d"].total_jobs) == (1, 2, "r9", 0)
    assert got["b"].health_result is None and got["b"].fetch_result.status == "healthy"


def test_run_life(spark):
    none = spark.createDataFrame([], "run_id string, run_type string, scope string, created_at string, total_companies int, settings string, targets string, status string, started_at string, finished_at string, error string")
    asked = spark.createDataFrame([("r", "fetch", "all", "1", 3, None, '["a"]'), ("s", "verify", "all", "1", 3, "{}", None)], "run_id string, run_type string, scope string, created_at string, total_companies int, settings string, targets string")
    made = runs.create(none, asked)
    assert {(r.run_id, r.status, r.settings, r.targets) for r in made.collect()} == {("r", "queued", "{}", '["a"]'), ("s", "queued", "{}", "[]")}
    begun = runs.start(made, spark.createDataFrame([("r", "2")], "run_id string, started_at string"))
    ended = runs.finish(begun, spark.createDataFrame([("r", "x", "3"), ("s", "", "4")], "run_id string, error string, finished_at string"))
    got = {r.run_id: (r.status, r.started_at, r.finished_at, r.error) for r in ended.collect()}
    assert got == {"r": ("failed", "2", "3", "x"), "s": ("completed", None, "4", "")}
    assert {r.status for r in runs.create(begun, asked).collect()} == {"running", "queued"}
    marked = runs.artifact_errors(spark.createDataFrame([("r", 5)], "run_id string, snapshot_jobs int"), spark.createDataFrame([("r", "e"), ("t", "f")], "run_id string, artifact_error string"))
    assert {tuple(r) for r in marked.select("run_id", "snapshot_jobs", "artifact_error").collect()} == {("r", 5, "e"), ("t", None, "f")}


def test_rollup_counts_a_board_once(spark):
    rows = [("r", "a", "1", "failed", 9, 9, None), ("r", "a", "2", "healthy", 4, None, 3), ("r", "b", "1", "healthy_with_fallback", None, 1, 1)]
    got = runs.rollup(spark.createDataFrame(rows, "run_id string, company_id string, created_at string, status string, jobs_found int, new_jobs int, existing_jobs int")).collect()
    assert [tuple(r) for r in got] == [("r", 2, 1, 1, 0, 0, 4, 1, 4)]


def test_unhashed_state(spark):
    from tidewheel.functions.text import content_hash

    texts = spark.createDataFrame([("c", "a", "T", "P", None), ("c", "b", "T", "P", None)], "company_id string, external_id string, title string, location string, description string")
    state = texts.withColumns({"content_hash": F.lit(None).cast("string"), "first_seen": F.lit(1), "last_seen": F.lit(1), "changed_at": F.lit(1), "active": F.lit(False), "last_change_type": F.lit("new")})
    hashed = texts.select("company_id", "external_id", F.when(F.col("external_id") == "a", content_hash(F.col("title"), F.col("location"), F.col("description"))).otherwise("x").alias("content_hash"))
    assert {r.external_id: r.last_change_type for r in inventory.merge(state, hashed, F.lit(2)).collect()} == {"a": "unchanged", "b": "changed"}
    bare = state.drop("title", "location", "description")
    assert {r.last_change_type for r in inventory.merge(bare, hashed, F.lit(2)).collect()} == {"changed"}


def test_coverage(spark):
    row = "company_id string, external_id string, job_url string"
    provider = spark.createDataFrame([("a", "REF12345678", None), ("a", None, "https://x/jobs/22345678/"), ("a", "own", None), ("b", "1", None)], row)
    official = spark.createDataFrame([("a", i) for i in ("12345678", "22345678", "32345678", "32345678")], "company_id string, id string")
    detail = spark.createDataFrame([("a", "32345678", "32345678", None), ("a", "12345678", "other", None)], "company_id string, id string, external_id string, job_url string")
    totals = spark.createDataFrame([("a", 3, 3)], "company_id string, before long, after long")
    rows, verdicts = inventory.covered(provider, official, detail, totals)
    assert sorted((r.external_id or "", r.origin) for r in rows.collect()) == [("", "provider"), ("32345678", "official"), ("REF12345678", "provider"), ("own", "provider")]
    assert [tuple(r) for r in verdicts.collect()] == [("a", 3, 3, 0, None)]
    rows, verdicts = inventory.covered(provider, official, detail.limit(0), totals)
    assert rows.collect() == [] and [tuple(r) for r in verdicts.collect()] == [("a", 3, 3, 1, "coverage_failed")]


def test_next_pages(spark):
    def found(html, rule="scored"):
        page = spark.createDataFrame([(1, "https://h.example/a/b?q=1", html)], "page_id long, url string, html string")
        return [r.url for r in pages.next_pages(pages.links(page), rule).collect()]

    assert found('<a href="x" title="Next">a</a><a rel="NEXT" href="">b</a>') == ["https://h.example/a/x"]
    assert found('<a rel="next" href="">b</a><a rel="next" href="z">b</a>') == ["https://h.example/a/b?q=1"]
    assert found('<a href="z">›</a><a href="y" aria-label="next one">›</a>') == ["https://h.example/a/y"]
    assert found('<a href="z">›</a><a href="y" aria-label="next one">›</a>', "labelled") == ["https://h.example/a/z"]
    assert found('<a href="y">what is next</a>') == [] and found('<a href="y">what is next</a>', "labelled") == ["https://h.example/a/y"]
    assert found(None) == [] and found("<a>next</a>") == []
    with pytest.raises(ValueError):
        found("", "best")


def test_browser_marks(spark):
    rows = [("a", "lever", None), ("b", "browser_html", None), ("c", None, '{"_source_response_url": "u"}'), ("d", "lever", '{"_fetch_via_browser": false}')]
    got = health.browser_used(spark.createDataFrame(rows, "company_id string, source_type string, raw string"))
    assert {r.company_id: r.browser for r in got.collect()} == {"a": False, "b": True, "c": True, "d": False}


def test_positions(spark):
    def read(*rows, **more):
        body = json.dumps({"positions": list(rows)})
        return landing.pcs_positions(spark.createDataFrame([("c", body)], "company_id string, body string"), "https://t.example", "a b.com", **more).collect()

    one = read({"id": 5, "title": " Cook ", "locations": [" Pune", None, "Goa", "Pune"], "description": " ", "content": "<p>x</p>", "positionUrl": "rel", "publicUrl": "ftp://x"})[0]
    assert (one.external_id, one.title, one.location, one.description) == ("5", "Cook", "Pune | Goa", "x")
    assert one.job_url == "https://t.example/careers/job/5?domain=a+b.com&hl=en"
    rows = [{"id": 1, "name": "a", "standardizedLocations": ["Pune, MH, in "]}, {"id": 2, "name": "b", "locations": ["West Indiana"]}, {"id": 3, "name": "c", "standardizedLocations": ["Berlin"]}, {"id": 4, "name": "d"}]
    assert [r.external_id for r in read(*rows, india_only=True)] == ["1", "2"]
    for broken in ({"name": "no id"}, {"id": 7, "name": " "}):
        with pytest.raises(Exception, match="no id or no title"):
            read({"id": 1, "name": "a"}, broken)


def test_skill_evidence(spark):
    p = spark.createDataFrame([("c", "1", "Cook", "Pune", "terraform and sql", None, None)], "company_id string, external_id string, title string, location string, description string, job_url string, posted_at string")
    row = relevance.score(p).collect()[0]
    assert {(s.name, s.points, s.context, s.evidence) for s in row.matched_supporting} == {("Terraform", 1.27, "general", "demonstrated"), ("SQL / PostgreSQL", 1.7, "general", "resume_skill")}


def test_legacy_copy_only_into_an_empty_table(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "id string, local long, gone string")
    full = spark.createDataFrame([("b", 9, None)], "id string, score long, note string")
    copy = lambda t: [tuple(r) for r in inventory.copy_legacy(t, old, {"local": "score"}, ["id"], ["local"]).collect()]
    assert copy(full) == [("b", 9, None)] and copy(full.limit(0)) == [("a", 1, None)]


def test_board_identity(spark):
    from tidewheel.operators import discovery

    cases = {
        "https://boards.greenhouse.io/Acme/jobs/7": ("greenhouse", "Acme", None),
        "https://boards.greenhouse.io/": None,
        "https://api.lever.co/acme": ("lever", "acme", None),
        "https://lever.co/acme": None,
        "https://jobs.smartrecruiters.com/careers/Acme": ("smartrecruiters", "Acme", None),
        "https://EIGHTFOLD.ai/": ("eightfold", "app", None),
        "https://a.b.eightfold.ai:443/": ("eightfold", "b", None),
        "https://x.jobs2web.com": ("successfactors", None, None),
        "https://h.oraclecloud.com/hcmui/candidateexperience/en/sites/CX_1": ("oracle", None, "CX_1"),
        "https://h.oraclecloud.com/other": None,
        "https://a.wd3.myworkdayjobs.com/EN-US/en/Site": ("workday", "a", "Site"),
        "https://a.b.wd3.myworkdayjobs.com/Site": None,
        "https://a.wd3.myworkdayjobs.com/en": None,
        "not a url": None,
        None: None,
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", discovery.board(F.col("u")).alias("b")).collect()
    assert {r.u: r.b and (r.b.provider, r.b.tenant, r.b.site) for r in rows} == cases
    posted = spark.createDataFrame([("a", '{"_source_response_url": "%s"}' % u) for u in "bacb"] + [("a", None), ("z", "[")], "company_id string, raw string")
    assert [tuple(r) for r in discovery.endpoints(posted, 2).collect()] == [("a", ["a", "b"])]


def test_run_detail(spark):
    from tidewheel.operators import search

    rows = [("r", "a", "A", None, "{"), ("r", "b", "B", 2, '{"x": 1}'), ("r", "c", "C", 1, None), ("s", "d", "D", 1, "{}")]
    got = search.run_detail(spark.createDataFrame(rows, "run_id string, company_id string, company_name string, rank int, payload string"), "r")
    assert [(r.company_id, r.p) for r in got.orderBy("place").select("company_id", F.to_json("payload").alias("p")).collect()] == [("c", "{}"), ("b", '{"x":1}'), ("a", "{}")]
    listed = spark.createDataFrame([("1", "fetch", "2"), ("2", "verify", "3"), ("3", "fetch", "3")], "run_id string, run_type string, created_at string")
    assert [r.run_id for r in search.run_list(listed).collect()] == ["3", "2", "1"] and [r.run_id for r in search.run_list(listed, "fetch", 1).collect()] == ["3"]
