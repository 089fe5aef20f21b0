import json

from pyspark.sql import functions as F

from tidewheel.operators import health
from tidewheel.sources import landing

ROW = "company_id string, ord int, external_id string, title string, location string, description string, job_url string, source_type string"


def test_every_verdict(spark):
    boards = [("manual", False, "manual", "by hand"), ("off", False, "auto", " "), ("waf", True, "auto", None), ("dns", True, "lever", None), ("full", True, "lever", None), ("part", True, "lever", None), ("more", True, "lever", None), ("bad", True, "lever", None), ("dead", True, "lever", None), ("none", True, "lever", None), ("zero", True, "lever", None), ("guess", True, "lever", None), ("junk", True, "auto", None), ("open", True, "lever", None), ("auto", True, "auto", None)]
    outcomes = [(b[0], "RecoverySource" if b[0] == "open" else "LeverSource", {"waf": "http_403_or_waf", "dns": "network_dns"}.get(b[0]), {"waf": "E: 403", "dns": "E: dns"}.get(b[0])) for b in boards]
    rows = lambda board, n, url="https://x.example/job/{}", title="Data Engineer": [(board, i, str(i), title, "Pune", None, url.format(i), "lever") for i in range(n)]
    table = [r for b in ("full", "part", "more", "dead", "open", "auto") for r in rows(b, 4)] + rows("bad", 3) + [("bad", 9, "z9", "Data Architect", "Agra", None, "nourl", "lever")] + [(b, i, x, "Careers", p, d, "https://x.example/careers", "generic_html") for b, i, x, _, p, d, _, _ in rows("junk", 2)] + rows("off", 5)
    probes = [("full", 4, "verified", None), ("part", 8, "verified", None), ("more", 3, "verified", None), ("zero", 0, "verified", None), ("guess", 0, "unknown", "said zero"), ("open", None, "unsupported", "no probe"), ("off", 9, "verified", None)]
    details = [("dead", "dead"), ("dead", "verified"), ("full", "verified"), ("full", "reachable_unconfirmed")]
    found = health.certify(
        spark.createDataFrame(boards, "company_id string, enabled boolean, source_type string, reason string"), spark.createDataFrame(outcomes, "company_id string, adapter string, category string, error string"), spark.createDataFrame(table, ROW),
        spark.createDataFrame(probes, "company_id string, expected_count long, status string, evidence string"), spark.createDataFrame(details, "company_id string, status string"),
    ).collect()
    got = {r.company_id: r for r in found}
    assert {k: r.verdict for k, r in got.items()} == {
        "manual": "BLOCKED", "off": "DISABLED", "waf": "BLOCKED", "dns": "FAILED", "full": "CERTIFIED", "part": "PARTIAL", "more": "INVALID", "bad": "INVALID", "dead": "INVALID", "none": "EMPTY_UNVERIFIED", "zero": "CERTIFIED", "guess": "EMPTY_UNVERIFIED", "junk": "INVALID", "open": "UNVERIFIED", "auto": "UNVERIFIED",
    }
    assert (got["manual"].error, got["off"].error, got["off"].failure_category, got["off"].jobs_found, got["off"].adapter, got["off"].expected_count) == ("by hand", "company is disabled in config", "manual_or_disabled", 0, None, None)
    assert (got["part"].error, got["part"].completeness_pct, got["part"].failure_category) == ("provider expected 8 unique jobs but adapter returned 4", 50.0, "incomplete_fetch")
    assert (got["dns"].error, got["dns"].failure_category, got["dns"].adapter) == ("E: dns", "network_dns", "LeverSource")
    assert got["dead"].error == "invalid/dead URLs=1; valid_url_ratio=1.0; rejected_non_job=0" and got["dead"].detail_verified == 1
    assert (got["junk"].raw_records, got["junk"].rejected_non_job_records, got["junk"].jobs_found) == (2, 2, 0)
    assert got["zero"].completeness_pct == 100.0 and got["guess"].error == "said zero"
    assert got["open"].recommended_action == health.GENERIC_SOURCE and got["none"].recommended_action == health.NO_PROBE and got["full"].detail_verified == 1
    counts = {r.verdict: r.n for r in health.verdict_counts(spark.createDataFrame(found)).collect()}
    assert counts["INVALID"] == 4 and sum(counts.values()) == 15


def test_tolerance_and_caps(spark):
    lists = lambda *r: spark.createDataFrame(list(r), "company_id string, id string")
    got = {r.company_id: (r.differing, r.stable) for r in health.stable_within(lists(("a", "1"), ("a", "2"), ("b", "1"), ("b", "2"), ("b", "3"), ("a", "1")), lists(("a", "3"), ("a", "2"), ("c", "1")), ["id"], "company_id").collect()}
    assert got == {"a": (2, True), "b": (3, False), "c": (1, True)}
    log = spark.createDataFrame([("x", 0, "1", 2001), ("x", 1, "2", 5), ("y", 0, "1", 2000)], "board string, page_no int, external_id string, total long")
    assert [tuple(r) for r in health.over_cap(log, 2000).collect()] == [("x", "total_over_cap", 2001)]


def payloads(spark, *bodies, **more):
    df = spark.createDataFrame([("c", b if isinstance(b, str) or b is None else json.dumps(b)) for b in bodies], "company_id string, body string")
    return df.withColumns({k: F.lit(v) for k, v in more.items()}) if more else df


def test_groups_lists_and_places(spark):
    grouped = {"job_data": {"Z": [{"req_id": "1", "title": "Baker", "primaryLocation": "Pune", "AdditionalLocations": "Agra", "JobID": "a b"}, {"title": "No id"}], "A": [{"req_id": "1", "title": "Later"}, {"JobID": "2", "title": " Cook ", "primaryLocation": "Pune, Agra", "AdditionalLocations": "Agra", "careerSiteDept": "Own"}]}}
    got = {r.external_id: (r.title, r.location, r.description, r.job_url) for r in landing.grouped_map(payloads(spark, grouped)).collect()}
    assert got == {"1": ("Baker", "Pune; Agra", "Z", "https://www.cohesity.com/careers/open-positions/?gh_jid=a+b&type=wd"), "2": ("Cook", "Pune, Agra", "Own", "https://www.cohesity.com/careers/open-positions/?gh_jid=2&type=wd")}
    plain = landing.grouped_map(payloads(spark, {"job_data": [{"req_id": "7", "title": "Cook", "jobUrl": "https://u"}]}, "{", None, {"job_data": 4})).collect()
    assert [(r.external_id, r.job_url) for r in plain] == [("7", "https://u")]


def test_totals_and_relative_links(spark):
    total = landing.oracle_total(payloads(spark, {"TotalJobsCount": 3, "items": [{"TotalJobsCount": 9}, {"x": 1}]}, {"items": []})).collect()
    assert [(r.company_id, r.total) for r in total] == [("c", 9)]
    body = {"jobs": [{"n": "Cook", "u": "j/1"}, {"n": "Baker", "u": None}, {"n": "Clerk", "u": "https://z/1"}]}
    got = {r.title: r.job_url for r in landing.mapped(payloads(spark, body, career_url="https://h.com/a/"), "custom_api", "jobs", {"title": "n", "job_url": "u"}).collect()}
    assert got == {"Cook": "https://h.com/a/j/1", "Baker": None, "Clerk": "https://z/1"}


def test_india_openings(spark):
    raw = lambda **k: json.dumps(k)
    rows = [(1, "12345", "A", "Pune", None, None), (2, "x", "B", None, None, raw(locations=[{"city": "Chennai"}], jobId=67890)), (3, "3", "C", "Delhi", "https://jobs.uber.com/en/jobs/31/", None), (4, "4", "D", "Delhi", "https://x/4", None), (5, "55555", "E", "Rome", None, None), (6, "66666", "F", "Pune", None, raw(status=" Closed ")), (7, "77777", "G", "Pune", None, raw(isJobClosed=True)), (8, "/j/88888/", "H", "Noida", None, raw(jobStatus="open")), (9, "12345", "a", "pune", None, None)]
    got = {r.ord: (r.external_id, r.job_url) for r in landing.india_openings(spark.createDataFrame(rows, "ord int, external_id string, title string, location string, job_url string, raw string")).collect()}
    assert got == {1: ("12345", "https://jobs.uber.com/en/jobs/12345/"), 2: ("67890", "https://jobs.uber.com/en/jobs/67890/"), 3: ("3", "https://jobs.uber.com/en/jobs/31/"), 8: ("88888", "https://jobs.uber.com/en/jobs/88888/")}
