import json
from types import SimpleNamespace

import pytest

from tidewheel.operators.stored import stored
from tidewheel.sources import landing, sinks


def payloads(spark, *bodies):
    return spark.createDataFrame([("c", b if b is None or isinstance(b, str) else json.dumps(b)) for b in bodies], "company_id string, body string")


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_boards(spark):
    g = only(landing.greenhouse(payloads(spark, {"jobs": [{"id": 7, "title": "Baker", "location": {"name": "Pune"}, "content": "&lt;p&gt;a &amp;amp; b&lt;/p&gt;", "updated_at": "2026-01-02"}, {"id": 8}]}, "{", None)))
    assert (g.external_id, g.location, g.description, g.posted_at) == ("7", "Pune", "a & b", "2026-01-02")
    v = only(landing.lever(payloads(spark, [{"id": "x", "text": "Baker", "descriptionPlain": "a", "additionalPlain": "b", "categories": {"location": "", "allLocations": ["Pune", "Goa"]}}])))
    assert (v.location, v.description) == ("Pune, Goa", "a\n\nb")
    assert only(landing.ashby(payloads(spark, {"jobs": [{"title": "Baker", "jobUrl": "https://u", "descriptionHtml": "<p>"}]}))).external_id == "https://u"
    assert only(landing.smartrecruiters(payloads(spark, {"content": [{"id": "1", "name": "Baker", "location": {"city": "Pune", "region": "", "country": "in"}}]}))).location == "Pune, in"
    w = only(landing.workday(payloads(spark, {"total": 1, "jobPostings": [{"title": "Baker", "externalPath": "/job/1", "bulletFields": ["R1", "x"]}]}), "h.example", "en-US", "Site"))
    assert (w.external_id, w.job_url) == ("R1", "https://h.example/en-US/Site/job/1")
    o = landing.oracle_requisitions(payloads(spark, {"items": [{"requisitionList": [{"Id": "5", "Title": "Baker", "ShortDescriptionStr": "a", "ExternalQualificationsStr": "b"}]}], "requisitionList": [{"Id": "6", "Title": "Cook"}]}), "h", "en", "S")
    assert sorted((r.external_id, r.description) for r in o.collect()) == [("5", "a\n\nb"), ("6", "")]
    p = only(landing.pcs_positions(payloads(spark, {"positions": [{"id": 3, "name": "Baker", "locations": ["Pune", "Goa"], "standardizedLocations": ["Goa"], "postedTs": "0"}]}), "https://o"))
    assert (p.location, p.job_url, p.posted_at) == ("Pune | Goa", "https://o/careers/job/3", None)
    m = landing.grouped_map(payloads(spark, {"job_data": {"A": [{"req_id": "1", "title": "Baker"}], "B": [{"JobID": "1", "title": "Baker"}, {"JobID": "2", "title": "Cook"}]}}))
    assert sorted(r.external_id for r in m.collect()) == ["1", "2"]


def test_search_pages(spark):
    places = [{"Address": "", "City": "Pune", "Region": None, "Country": "India"}, {"Address": "Goa"}, {"Address": "Goa"}]
    first = {"page": 1, "jobs": [{"Id": 1, "Title": "Baker"}, {"Id": 2, "Title": "Cook", "Locations": places, "Description": "<p>a</p>", "Summary": "b"}, {"Title": "no id"}]}
    rows = {r.external_id: r for r in landing.uber_positions(payloads(spark, {"page": 2, "jobs": [{"Id": "1", "Title": "Head Baker"}]}, first)).collect()}
    assert rows.keys() == {"1", "2"} and rows["1"].title == "Head Baker" and rows["1"].location is None
    assert (rows["2"].location, rows["2"].job_url) == ("Pune, India | Goa", "https://jobs.uber.com/en/jobs/2/")
    assert rows["2"].description.split() == ["a", "b"]
    with pytest.raises(Exception, match="no title: 3"):
        landing.uber_positions(payloads(spark, {"jobs": [{"Id": "3"}]})).collect()
    listed = ['{"normalizedCityName": "Pune", "country": "India"}', {"city": "Goa", "state": ""}, "Delhi ", "Delhi", "{broken"]
    jobs = [{"title": "Baker", "job_path": "/en/jobs/77/baker", "locations": listed, "description": " a ", "preferred_qualifications": "b"}, {"title": "Cook", "url": "https://u", "location": "Agra", "postedDate": "May 1"}, {"title": " "}]
    a, b = sorted(landing.amazon_search(payloads(spark, {"jobs": jobs}, "[", None)).collect(), key=lambda r: r.ord)
    assert (a.external_id, a.job_url, a.location, a.description) == ("77", "https://www.amazon.jobs/en/jobs/77/baker", "Pune, India; Goa; Delhi; {broken", "a\n\nb")
    assert (b.external_id, b.job_url, b.location, b.posted_at) == ("https://u", "https://u", "Agra", "May 1")


def test_mapped_fields(spark):
    fields = {"external_id": "meta.id", "title": "name", "location": "place.city"}
    row = only(landing.mapped(payloads(spark, {"data": {"list": [{"name": " Head  Baker ", "meta": {"id": 4}}]}}), "custom_api", "data.list", fields))
    assert (row.external_id, row.title, row.location) == ("4", "Head Baker", None)
    with pytest.raises(Exception, match="is not a list"):
        landing.mapped(payloads(spark, {"data": {}}), "custom_api", "data.list", fields).collect()


def test_artifacts_are_written_once(spark):
    rows = spark.createDataFrame([("r1", "a", 1), ("r1", "b", 2), ("r2", "a", 1)], "run string, k string, v int")
    first = sinks.artifacts(rows, "run", ["k", "v"])
    empty = first.limit(0)
    assert sinks.write_once(first, empty, ["run"]).count() == 2
    assert sinks.write_once(first, sinks.artifacts(rows.repartition(5), "run", ["k", "v"]), ["run"]).count() == 0
    changed = sinks.artifacts(rows.replace(2, 3, subset=["v"]), "run", ["k", "v"])
    with pytest.raises(Exception, match="other content"):
        sinks.write_once(changed, first, ["run"]).collect()


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([("c", "1", 70.0, True, [("Java",)]), ("c", "2", 10.0, False, [])], "company_id string, external_id string, relevance_score double, is_relevant boolean, matched_primary array<struct<name:string>>")
    sinks.relevance_export(rows, f"{tmp_path}/x", "csv", relevant_only=True)
    assert spark.read.option("header", True).csv(f"{tmp_path}/x").first().matched_primary == "Java"
    with pytest.raises(ValueError, match="unknown format"):
        sinks.relevance_export(rows, f"{tmp_path}/y", "xml")


def test_no_machine_local_tables_on_a_cluster():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        stored(SimpleNamespace(sparkSession=session), "x")
