import os

from pyspark.sql import functions as F

from tidewheel.operators import search
from tidewheel.operators.deliveries import Deliveries
from tidewheel.operators.stored import files_key, stored_once
from tidewheel.sources import sinks

HEALTH = "rank int, id string, name string, status string, jobs_found long, failure_category string, source_types array<string>"


def text(path):
    return "".join(open(f"{path}/{n}").read() for n in sorted(os.listdir(path)) if n.startswith("part"))


def test_health_reports_keep_history_and_last_good_counts(spark, tmp_path):
    root = f"{tmp_path}/h"
    rows = lambda *r: spark.createDataFrame(list(r), HEALTH)
    counts = lambda: {r.company_id: r.jobs_found for r in sinks.read_baseline(spark, root).collect()}
    assert counts() == {}
    s = sinks.write_health(rows((2, "b", "B", "healthy", 5, None, ["x", "y"]), (1, "a", "A", "failed", 0, "rate_limited", [])), root, "2026-01-01T10:00:00Z").first()
    assert (s.verified, s.healthy, s.failed, s.environment_blocked) == (2, 1, 1, False) and counts() == {"b": 5}
    lines = text(f"{root}/latest/csv").splitlines()
    assert lines[0] == "rank,id,name,status,jobs_found,failure_category,source_types" and lines[-1] == "2,b,B,healthy,5,,x | y" and len(lines) == 3
    # most boards fail by the name service: counts stay
    assert sinks.write_health(rows((1, "a", "A", "failed", 0, "network_dns", []), (2, "b", "B", "suspicious", 1, "network_dns", [])), root, "2026-01-02T10:00:00Z").first().environment_blocked
    assert counts() == {"b": 5}
    sinks.write_health(rows((1, "a", "A", "healthy", 7, None, [])), root, "2026-01-02T11:00:00Z")
    sinks.write_health(rows((1, "a", "A", "healthy", 8, None, [])), root, "2026-01-02T11:00:00Z")
    assert counts() == {"a": 8, "b": 5}
    history = spark.read.parquet(f"{root}/history").groupBy("generated_at").agg(F.count("*").alias("n")).orderBy("generated_at").collect()
    assert [r.n for r in history] == [2, 2, 1] and '"id":"a"' in text(f"{root}/latest/json")


def test_certification_report(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", "B|x", True, "PARTIAL", 3, 4, 75.0, None, "do a|b"), (None, "c", None, False, None, None, None, None, "h", None), (1, "a", "A", True, "CERTIFIED", 9, 9, 100.0, "api", "")], "rank int, id string, name string, enabled boolean, verdict string, jobs_found long, expected_count long, completeness_pct double, adapter string, recommended_action string")
    s = sinks.write_certification(rows, f"{tmp_path}/c", "T").first()
    assert (s.companies, s.certified, s.needs_attention) == (3, 1, 1)
    md = text(f"{tmp_path}/c/markdown").splitlines()
    assert md[4] == "Certified: **1** / 3 configured companies" and len(md) == 11
    assert md[8:] == ["| 1 | A | **CERTIFIED** | 9 | 9 | 100.0% | `api` |  |", "| 2 | B/x | **PARTIAL** | 3 | 4 | 75.0% | `-` | do a/b |", "| - | c | **-** | - | ? | ? | `h` |  |"]
    assert text(f"{tmp_path}/c/csv").splitlines()[0].startswith("rank,id,name,enabled,verdict,adapter,jobs_found")


def test_dated_copies(spark, tmp_path):
    store = Deliveries(spark, f"{tmp_path}/d", None)
    runs = spark.createDataFrame([("r1", "2026-01-31T01", None), ("r2", "2026-02-01T01", None)], "run string, created_at string, started_at string")
    events = spark.createDataFrame([("r1", "c", "a", "x", "new", True), ("r2", "c", "a", "y", "changed", True)], "run string, company_id string, external_id string, content string, event string, observed boolean")
    versions = spark.createDataFrame([("c", "a", k, "C", "T", "L", "D") for k in "xy"], "company_id string, external_id string, content string, company_name string, title string, location string, description string")
    analysis = spark.createDataFrame([("c", "a", "P", "f", 1.0, 2.0, 50.0, "good", True)], "company_id string, external_id string, normalized_location string, role_family string, min_experience double, max_experience double, relevance_score double, relevance_status string, is_relevant boolean")
    store.finalize(runs, events, analysis, versions, "t")
    for _ in range(2):
        sinks.dated_copies(store.jobs(), store.manifest(), f"{tmp_path}/copies")
    got = {(r.year, r.month, r["copy"], r.n) for r in spark.read.parquet(f"{tmp_path}/copies/ai_input").groupBy("year", "month", "copy").agg(F.count("*").alias("n")).collect()}
    assert got == {(2026, 1, "2026-01-31_r1", 1), (2026, 2, "2026-02-01_r2", 1)} and spark.read.parquet(f"{tmp_path}/copies/manifest").count() == 2


ROWS = [
    ("a", "1", "Acme", "Java Engineer", "Pune", "d java", "2026-01-05", 5, True, "new", "Pune, India", "java", 80.0, "high", True, None),
    ("a", "2", "Acme", "Cook", "Rome", "d", "2026-01-01", 1, True, "changed", "Rome", "other", 20.0, "filtered", False, "role"),
    ("b", "3", "Bolt", "Java Dev", None, "x", None, 9, True, "unchanged", "India", "java", 80.0, "good", True, None),
    ("b", "4", "Bolt", "Java Dev", "Goa", "x", "2026-02-01", 9, False, "new", "Goa, India", "java", 90.0, "high", True, None),
    ("b", "5", "Bolt", "Late", "Goa", "x", "2026-02-01", 9, True, "new", None, None, None, None, None, None),
    ("c", "6", "Cold", "Baker", "Agra", "100% java", "2026-01-09", 2, True, None, "Agra, India", "other", 30.0, "filtered", False, None),
]
SCHEMA = "company_id string, external_id string, company_name string, title string, location string, description string, posted_at string, first_seen_day int, active boolean, last_change_type string, normalized_location string, role_family string, relevance_score double, relevance_status string, is_relevant boolean, filter_reason string"


def test_relevance_search_with_totals(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    ids = lambda **k: [r.external_id for r in search.relevance_page(rows, **k).collect()]
    assert ids() == ["1", "3", "6"] and ids(target_only=False) == ["1", "3", "6", "2", "5"] or ids(target_only=False)[:4] == ["1", "3", "6", "2"]
    assert ids(query="JAVA") == ["1", "3", "6"] and ids(query="100%") == ["6"] and ids(company_id="b") == ["3"] and ids(status="high") == ["1"] and ids(family="java") == ["1", "3"]
    assert ids(change_type="new") == ["1"] and ids(relevant_only=True) == ["1", "3"] and ids(min_score=31) == ["1", "3"] and ids(posted_since="2026-01-06") == ["6"] and ids(first_seen_since=F.lit(5)) == ["1", "3"]
    page = search.relevance_page(rows, number=2, size=2).collect()
    assert [(r.external_id, r.total, r.pages) for r in page] == [("6", 3, 2)]
    assert [r.pages for r in search.relevance_page(rows, number=-1, size=0).collect()] == [3]


def test_all_figures_in_one_row(spark):
    r = search.relevance_stats(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.active_jobs, r.analyzed, r.pending, r.relevant_jobs, r.new_changed, r.relevant_new_changed) == (5, 4, 1, 2, 2, 1)
    assert r.statuses == {"high": 1, "good": 1, "filtered": 2} and r.filter_reasons == {"role": 1, "unknown": 1}
    none = search.relevance_stats(spark.createDataFrame([], SCHEMA)).first()
    assert (none.active_jobs, none.pending, none.statuses) == (0, 0, {})


def test_run_pages_and_lookups(spark):
    rows = spark.createDataFrame([("r", "a", str(i), "Acme", f"T{i % 2}", "Pune", e, s, s is not None) for i, (e, s) in enumerate([("unchanged", 9.0), ("closed", None), ("changed", 1.0), ("new", 2.0), ("new", None), ("new", 7.0)])] + [("q", "a", "9", "Acme", "T", "P", "new", 1.0, True)], "run string, company_id string, external_id string, company_name string, title string, location string, event string, relevance_score double, is_relevant boolean")
    ids = lambda **k: [r.external_id for r in search.run_page(rows, "r", **k).collect()]
    assert ids() == ["5", "3", "4", "2", "1", "0"] and ids(event="new", relevant=False) == ["4"] and ids(query="t1", min_score=1.5) == ["5", "3"] and ids(company_id="z") == [] and ids(number=2, size=4) == ["1", "0"]
    assert search.lookup(rows, run="q", company_id="a", external_id="9").count() == 1


def test_daily_scan(spark, tmp_path):
    fetched = spark.createDataFrame([("a", "healthy"), ("b", "failed")], "id string, status string")
    rows = spark.createDataFrame(ROWS, SCHEMA)
    lines = sinks.daily_scan(fetched, rows.where("relevance_score is not null"), search.relevance_stats(rows), f"{tmp_path}/day")
    assert lines[0] == "Companies attempted:     2" and lines[1] == "Fetch failed/suspicious: 1 / 0" and lines[-1] == "Relevant NEW/CHANGED:    1" and len(lines) == 11
    assert spark.read.option("header", True).csv(f"{tmp_path}/day/relevant_jobs_csv").columns[:3] == ["company_name", "title", "location"]


def test_tables_are_made_once_for_the_same_files(spark, tmp_path):
    made = []
    spark.range(3).write.parquet(f"{tmp_path}/t")

    def table():
        return stored_once(lambda: made.append(1) or spark.read.parquet(f"{tmp_path}/t"), "once", files_key(spark, f"{tmp_path}/t"), spark)

    assert table().count() == 3 and table().count() == 3 and len(made) == 1
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/t")
    assert table().count() == 8 and len(made) == 2
