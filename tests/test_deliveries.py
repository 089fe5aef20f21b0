import json
import os

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import deliveries, inventory
from tidewheel.operators.deliveries import Deliveries

EVENT = "run string, company_id string, external_id string, content string, event string, observed boolean"
VERSION = "company_id string, external_id string, content string, company_name string, title string, location string, description string, job_url string"
ANALYSIS = "company_id string, external_id string, normalized_location string, role_family string, min_experience double, max_experience double, relevance_score double, relevance_status string, is_relevant boolean"
RUN = "run string, run_type string, created_at string, started_at string"


def version(i, content, location="Bengaluru, India", description="3+ years Java", title="Java Engineer"):
    return ("acme", i, content, "Acme", title, location, description, f"https://jobs.example/{i}")


def score(i, points, relevant=True, place="Bengaluru, India"):
    return ("acme", i, place, "java_backend", 3.0, None, points, "good" if relevant else "low", relevant)


@pytest.fixture
def world(spark, tmp_path):
    """A run that sees a changed and a new posting and closes one, and a later one that sees both as they were."""
    class World:
        store = Deliveries(spark, f"{tmp_path}/reports")
        runs = spark.createDataFrame([("r1", "fetch", "2026-01-01", "2026-01-01T01"), ("r2", "fetch", "2026-01-02", None)], RUN)
        events = spark.createDataFrame(
            [("r1", "acme", "a", "a2", "changed", True), ("r1", "acme", "b", "b1", "new", True), ("r1", "acme", "c", "c1", "closed", False), ("r1", "acme", "d", "d1", "unchanged", True), ("r2", "acme", "a", "a2", "unchanged", True), ("r2", "acme", "b", "b2", "changed", True)], EVENT
        )
        versions = spark.createDataFrame([version("a", "a1"), version("a", "a2"), version("b", "b1", title="SDE II"), version("b", "b2", title="SDE II"), version("c", "c1"), version("d", "d1")], VERSION)
        analysis = spark.createDataFrame([score("a", 70.0), score("b", 80.0), score("c", 90.0), score("d", 60.0)], ANALYSIS)

        def finalize(self, runs=("r1", "r2"), analysis=None):
            return {r.run: r for r in self.store.finalize(self.runs.where(F.col("run").isin(*runs)), self.events, self.analysis if analysis is None else analysis, self.versions, "2026-01-03").collect()}

        def ids(self, run):
            return [r.external_id for r in self.store.jobs().where(F.col("run") == run).orderBy("place").collect()]

    return World()


def files(root):
    return sorted(f"{d}/{n}" for d, _, names in os.walk(root) for n in names)


def test_a_run_is_frozen_and_written_once(world, spark):
    s = world.finalize(["r1"])["r1"]
    assert (s.snapshot_jobs, s.jobs_new, s.jobs_changed, s.jobs_unchanged, s.jobs_closed, s.new_relevant, s.changed_relevant, s.ai_input_count) == (3, 1, 1, 1, 1, 1, 1, 2)
    rows = world.store.jobs().orderBy("place").collect()
    assert [(r.place, r.external_id, r.event) for r in rows] == [(1, "b", "new"), (2, "a", "changed")]
    job = json.loads(rows[0].job)
    assert job["event_type"] == "new" and job["is_relevant"] is True and job["max_experience"] is None and "India" in job["normalized_location"] and job["title"] == "SDE II" and "content" not in job
    before, digest = files(world.store.root), world.store.manifest().first().payload_sha256
    # other scores later change nothing, and a second call writes nothing
    again = world.finalize(["r1"], spark.createDataFrame([score("a", 1.0, False), score("b", 2.0, False)], ANALYSIS))["r1"]
    assert again == s and files(world.store.root) == before and world.store.manifest().first().payload_sha256 == digest
    frozen = {r.external_id: (r.event, r.relevance_score, r.observed) for r in world.store.frozen().collect()}
    assert frozen == {"a": ("changed", 70.0, True), "b": ("new", 80.0, True), "c": ("closed", 90.0, False), "d": ("unchanged", 60.0, True)}
    # the next run is added beside it
    both = world.finalize()
    assert both["r1"] == s and both["r2"].ai_input_count == 1 and world.store.commits() == [1, 2]


def test_first_delivery_is_a_baseline_later_ones_are_increments(world):
    world.finalize()
    m = {r.run: r for r in world.store.deliver(world.versions).collect()}
    assert (m["r1"].delivery_mode, m["r1"].schema_version, m["r1"].location_ruleset, m["r1"].baseline_relevant, m["r1"].ai_input_count, m["r1"].generated_at, m["r1"].jobs_closed) == ("baseline", 3, deliveries.LOCATION_RULES, 3, 3, "2026-01-03", 1)
    assert (m["r2"].delivery_mode, m["r2"].changed_relevant, m["r2"].ai_input_count) == ("incremental", 1, 1)
    assert world.ids("r1") == ["b", "a", "d"] and world.ids("r2") == ["b"]
    assert [r.external_id for r in world.store.latest().collect()] == ["b"]
    before = files(world.store.root)
    world.store.deliver(world.versions)
    assert files(world.store.root) == before
    lines = [r.line for r in world.store.lines("r1").collect()]
    assert json.loads(lines[0])["payload_sha256"] == m["r1"].payload_sha256 and len(lines) == 4


def test_delivery_of_single_runs_and_new_rules(world, monkeypatch):
    """A run is a baseline if no earlier one has been delivered; new rules rewrite all, modes stay."""
    world.finalize()
    m = {r.run: r.delivery_mode for r in world.store.deliver(world.versions, runs=["r2"]).collect()}
    assert m == {"r1": None, "r2": "baseline"} and world.ids("r2") == ["b", "a"]
    m = {r.run: r.delivery_mode for r in world.store.deliver(world.versions).collect()}
    assert m == {"r1": "baseline", "r2": "baseline"}
    monkeypatch.setattr(deliveries, "LOCATION_RULES", "places-2")
    m = {r.run: (r.delivery_mode, r.location_ruleset, r.snapshot_jobs) for r in world.store.deliver(world.versions).collect()}
    assert m == {"r1": ("baseline", "places-2", 3), "r2": ("incremental", "places-2", 2)} and world.ids("r2") == ["b"]


def test_places_are_classified_again_with_raw_of_the_same_content(world, spark):
    """Without a clear frozen location, the posting's own, and its raw payload while the content is the same, decide."""
    analysis = spark.createDataFrame([score("a", 70.0, place="Unknown"), score("b", 80.0, place="HQ"), score("d", 60.0, place="Berlin, Germany")], ANALYSIS)
    world.versions = spark.createDataFrame([version("a", "a2", "Pune"), version("b", "b1", "HQ"), version("b", "b2", "HQ"), version("c", "c1"), version("d", "d1", "Berlin, Germany")], VERSION)
    assert world.finalize(analysis=analysis)["r1"].ai_input_count == 0
    world.store.deliver(world.versions, runs=["r1"])
    assert world.ids("r1") == ["a"]
    raw = json.dumps({"primaryLocation": {"countryCode": "IN"}})
    current = spark.createDataFrame([("acme", "b", "b2", raw)], "company_id string, external_id string, content string, raw string")
    world.store.deliver(world.versions, current)
    assert world.ids("r1") == ["a"] and world.ids("r2") == ["b"]


def test_broken_commits_count_for_nothing(world):
    world.finalize(["r1"])
    m = world.store.manifest().first()
    world.store.jobs().withColumn("run", F.lit("r1")).write.partitionBy("run").parquet(f"{world.store.root}/payload/commit=2")
    os.makedirs(f"{world.store.root}/log/commit=3")
    assert world.store.manifest().first() == m and world.store.jobs().count() == 2
    world.finalize()
    assert world.store.commits() == [1, 4] and world.store.jobs().count() == 3


def test_odd_runs(spark, tmp_path, world):
    """No runs; a run without events; one whose versions are missing; other countries and none."""
    empty = Deliveries(spark, f"{tmp_path}/empty")
    assert empty.manifest().isEmpty() and empty.jobs().isEmpty() and empty.deliver(world.versions).isEmpty() and empty.latest().isEmpty()
    runs = spark.createDataFrame([("x", "fetch", "1", None), ("r1", "fetch", "2", None)], RUN)
    got = {r.run: r for r in empty.finalize(runs, world.events, world.analysis, world.versions.limit(0), "t").collect()}
    assert {k: (v.snapshot_jobs, v.ai_input_count) for k, v in got.items()} == {"x": (0, 0), "r1": (0, 0)}
    assert {r.run: r.delivery_mode for r in empty.deliver(world.versions).collect()} == {"x": "baseline", "r1": "incremental"}
    anywhere = Deliveries(spark, f"{tmp_path}/any", country=None)
    anywhere.finalize(runs, world.events, world.analysis.withColumn("normalized_location", F.lit("Berlin")), world.versions, "t")
    assert anywhere.jobs().count() == 2
    anywhere.deliver(world.versions)
    assert anywhere.jobs().count() == 2


def test_events_of_a_replay_can_be_finalized(spark, tmp_path):
    snapshots = spark.createDataFrame([("1", "acme", "a", "x"), ("1", "acme", "b", "x"), ("2", "acme", "a", "y")], "run string, company_id string, external_id string, content string")
    store = Deliveries(spark, f"{tmp_path}/d")
    versions = spark.createDataFrame([version(i, k) for i in "ab" for k in "xy"], VERSION)
    analysis = spark.createDataFrame([score("a", 70.0), score("b", 60.0)], ANALYSIS)
    runs = spark.createDataFrame([("1", "fetch", "1", None), ("2", "fetch", "2", None)], RUN)
    got = {r.run: (r.jobs_new, r.jobs_changed, r.jobs_closed, r.ai_input_count) for r in store.finalize(runs, inventory.replay(snapshots), analysis, versions, "t").collect()}
    assert got == {"1": (2, 0, 0, 2), "2": (0, 1, 1, 1)}


def test_finalizing_scores_the_postings_of_the_runs_only(spark, tmp_path, monkeypatch):
    """Of the given tables' postings few are in a run; the summaries are those of the whole analysis."""
    from tidewheel.operators import inventory
    from tidewheel.plans import artifacts, queries

    sf, scored, one = "/root/testdata/sf0.001", [], artifacts.relevance.score

    def seen(rows):
        scored.append({(r.company_id, r.external_id) for r in rows.select("company_id", "external_id").collect()})
        return one(rows)

    monkeypatch.setattr(artifacts, "shared_root", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(artifacts.relevance, "score", seen)
    got = {tuple(r) for r in artifacts._finalized(spark, sf).summaries().collect()}
    monkeypatch.undo()
    s = queries.V.snapshots(spark, sf).where("run is not null")
    keys = {(r.company_id, r.external_id) for r in s.select("company_id", "external_id").collect()}
    assert len(scored) == 1 and scored[0] and scored[0] <= keys
    run = F.col("run").cast("string")
    runs = s.select(run.alias("run")).distinct().select("run", F.col("run").alias("created_at"), F.lit(None).cast("string").alias("started_at"))
    whole = Deliveries(spark, f"file://{tmp_path}/whole").finalize(runs, inventory.replay(s), queries._analyses(spark, sf), artifacts._named(spark, sf), "2026-01-01T00:00:00Z")
    assert got == {tuple(r) for r in whole.collect()} and got
