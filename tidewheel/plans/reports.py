"""Registered queries over finalized runs, searches, boards and summaries, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.functions import text as T
from tidewheel.operators import inventory, relevance, runs, search
from tidewheel.operators.stored import stored
from tidewheel.plans import oracle as O
from tidewheel.plans import views as V
from tidewheel.plans.history import _ANALYSIS, _analysis
from tidewheel.plans.queries import _EVENTS, _POLICY, KEY, _analyses, c, query
from tidewheel.sources.landing import pcs_in_india

STATUSES = ["healthy", "failed", "suspicious", "healthy_with_fallback", "healthy", "never_verified"]
CATEGORIES = ["network_dns", None, "network_timeout", "network_dns", None, "rate_limited", "http_403_or_waf"]
VERDICTS = ["CERTIFIED", "PARTIAL", "INVALID", "UNVERIFIED", "EMPTY_UNVERIFIED", "FAILED", "BLOCKED", "CERTIFIED"]
CAREERS = [
    "https://boards.greenhouse.io/acme", "https://boards.greenhouse.io/embed/job_board?for=acme", "https://jobs.lever.co/acme/1", "https://jobs.ashbyhq.com/acme",
    "https://careers.smartrecruiters.com/Acme", "https://acme.wd5.myworkdayjobs.com/en/site", "https://acme.eightfold.ai/careers", "https://example.com/careers",
    "https://eeho.fa.us2.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/jobs", "https://careers.oracle.com/en/sites/jobsearch/jobs", "https://careers.swiggy.com/#/careers", "https://careers.oracle.com",
]
DETAILS = ["https://x.example/job/123-engineer", "https://x.example/details/44-2/", "https://x.example/jobs/77", "https://x.example/opportunity/ab-c", "https://x.example/p?a=1&jobId=99", "https://x.example/about", "https://x.example/careers/details/5"]

_FROZEN = f"""{_EVENTS}, {_POLICY.removeprefix("WITH ")}, vers AS (SELECT company_id, external_id, content, min(run) AS first_run FROM snapshots GROUP BY ALL),
  frozen AS (SELECT e.*, a.normalized_location, a.role_family, a.relevance_score, a.relevance_status, a.is_relevant, coalesce(a.is_relevant AND a.normalized_location ILIKE '%india%', false) AS ok
    FROM events_ e LEFT JOIN analysed a USING (company_id, external_id))"""


def _versions(spark, sf_dir):
    return V.snapshots(spark, sf_dir).groupBy(*KEY, "content").agg(F.min("run").alias("first_run"))


def _frozen(spark, sf_dir):
    seen = V.snapshots(spark, sf_dir)
    mine = V.postings(spark, sf_dir).join(seen.select(*KEY).distinct(), KEY, "left_semi")
    analysis = relevance.apply_location_policy(relevance.score(mine)).select(*KEY, *runs.FROZEN)
    return runs.freeze(inventory.replay(seen), stored(analysis, "frozen"))


@query("join05_frozen_scores", f"{_FROZEN} SELECT run, company_id, external_id, event, relevance_score, relevance_status FROM frozen")
def frozen_scores(spark, sf_dir):
    return _frozen(spark, sf_dir).select("run", *KEY, "event", "relevance_score", "relevance_status")


@query("evt02_finalize", f"{_FROZEN} SELECT run, company_id, external_id, event, relevance_score, role_family, normalized_location, first_run FROM frozen JOIN vers USING (company_id, external_id, content) WHERE event IN ('new', 'changed') AND ok")
def finalize(spark, sf_dir):
    return runs.finalize(_frozen(spark, sf_dir), _versions(spark, sf_dir)).select("run", *KEY, "event", "relevance_score", "role_family", "normalized_location", "first_run")


@query(
    "evt02_summary",
    f"""{_FROZEN} SELECT run, count(*) FILTER (observed) AS snapshot_jobs, count(*) FILTER (event = 'new') AS jobs_new, count(*) FILTER (event = 'changed') AS jobs_changed, count(*) FILTER (event = 'unchanged') AS jobs_unchanged, count(*) FILTER (event = 'closed') AS jobs_closed,
    count(*) FILTER (event = 'new' AND ok) AS new_relevant, count(*) FILTER (event = 'changed' AND ok) AS changed_relevant, count(*) FILTER (event IN ('new', 'changed') AND ok) AS ai_input_count FROM frozen GROUP BY 1""",
)
def run_summaries(spark, sf_dir):
    return runs.summarize(_frozen(spark, sf_dir))


_DELIVERED = f"{_FROZEN}, delivered AS (SELECT *, CASE WHEN run = (SELECT min(run) FROM events_) THEN 'baseline' ELSE 'incremental' END AS mode FROM frozen WHERE ok AND CASE WHEN run = (SELECT min(run) FROM events_) THEN observed ELSE event IN ('new', 'changed') END)"


def _delivered(spark, sf_dir):
    frozen = _frozen(spark, sf_dir)
    modes = inventory.delivery_modes(V.snapshots(spark, sf_dir).select("run").distinct().where("run is not null").withColumn("created_at", c("run")))
    return inventory.delivery(frozen, modes, runs.wanted())


@query("dlv01_relevant_delivery", f"{_DELIVERED} SELECT run, mode, company_id, external_id, event, relevance_score FROM delivered")
def relevant_delivery(spark, sf_dir):
    return _delivered(spark, sf_dir).select("run", "mode", *KEY, "event", "relevance_score")


@query("dlv02_all_deliveries", f"{_DELIVERED} SELECT run, mode, count(*) AS n FROM delivered GROUP BY ALL")
def all_deliveries(spark, sf_dir):
    return _delivered(spark, sf_dir).groupBy("run", "mode").agg(F.count("*").alias("n"))


@query("qry09_latest_delivery", f"{_DELIVERED} SELECT company_id, external_id, event FROM delivered WHERE run = (SELECT max(run) FROM delivered)")
def latest_delivery(spark, sf_dir):
    d = _delivered(spark, sf_dir).select("run", *KEY, "event")
    return d.join(F.broadcast(d.agg(F.max("run").alias("run"))), "run").drop("run")  # one row


@query(
    "join07_current_raw",
    f"{_FROZEN}, cur AS (SELECT company_id, external_id, content, 'raw ' || content AS raw FROM snapshots QUALIFY row_number() OVER (PARTITION BY company_id, external_id ORDER BY run DESC) = 1) SELECT run, company_id, external_id, first_run, raw FROM frozen JOIN vers USING (company_id, external_id, content) LEFT JOIN cur USING (company_id, external_id, content)",
)
def current_raw(spark, sf_dir):
    s = V.snapshots(spark, sf_dir)
    current = s.groupBy(*KEY).agg(F.max_by("content", "run").alias("content")).withColumn("raw", F.concat(F.lit("raw "), "content"))
    return runs.with_current(_frozen(spark, sf_dir), _versions(spark, sf_dir), current).select("run", *KEY, "first_run", "raw")


@query("flt17_run_filters", f"{_FROZEN} SELECT run, company_id, external_id, event FROM frozen WHERE event = 'new' AND NOT coalesce(is_relevant, false) AND coalesce(relevance_score, 0) >= 10")
def run_filters(spark, sf_dir):
    return search.run_jobs(_frozen(spark, sf_dir), event="new", relevant=False, min_score=10.0).select("run", *KEY, "event")


@query("flt09_target_location", f"{_POLICY} SELECT external_id, normalized_location ILIKE '%india%' AS in_target FROM analysed")
def target_location(spark, sf_dir):
    return _analyses(spark, sf_dir).select("external_id", runs.in_target(c("normalized_location")).alias("in_target"))


@query(
    "agg15_change_counters",
    f"""{_POLICY}, a AS (SELECT CAST(external_id AS BIGINT) % 4 IN (2, 3) AS analyzed, CASE WHEN last_change_type IS NOT NULL THEN last_change_type WHEN CAST(external_id AS BIGINT) % 4 = 3 THEN 'baseline' WHEN CAST(external_id AS BIGINT) % 4 = 2 THEN 'changed' ELSE 'unchanged' END AS change FROM analysed)
    SELECT {", ".join(f"count(*) FILTER (change = '{k}') AS {k}" for k in ("new", "changed", "baseline", "unchanged"))}, count(*) FILTER (analyzed) AS analyzed, count(*) FILTER (NOT analyzed) AS skipped FROM a""",
)
def change_counters(spark, sf_dir):
    from tidewheel.plans.queries import _previous

    out = relevance.analyze(V.postings(spark, sf_dir), _previous(spark, sf_dir))
    return out.agg(*(F.count_if(c("change_type") == k).alias(k) for k in ("new", "changed", "baseline", "unchanged")), F.count_if("analyzed").alias("analyzed"), F.count_if(~c("analyzed")).alias("skipped"))


# --- Searches ----------------------------------------------------------------------------------------------------

_ORDER = "ORDER BY active DESC, coalesce(posted_at, '') DESC, first_seen_day DESC, company_name, title, external_id"
_FOUND = f"WITH {O.POSTINGS}, f AS (SELECT * FROM postings WHERE (title ILIKE '%engineer%' OR description ILIKE '%engineer%' OR company_name ILIKE '%engineer%' OR location ILIKE '%engineer%') AND posted_at >= '2026-02' AND TRY_CAST(posted_at AS DATE) IS NOT NULL)"


def _newest():
    return [F.desc("active"), F.desc(T.blank(c("posted_at"))), F.desc("first_seen_day"), "company_name", "title", "external_id"]


@query("qry01_search_pages", f"{_FOUND} SELECT external_id, title, posted_at, (SELECT count(*) FROM f) AS total, CAST(greatest(1, ceil((SELECT count(*) FROM f) / 20)) AS BIGINT) AS pages FROM f {_ORDER} LIMIT 20 OFFSET 20")
def search_pages(spark, sf_dir):
    found = search.postings(V.postings(spark, sf_dir), query="engineer", posted_since="2026-02-01")
    return search.page(found, _newest(), 2, 20).select("external_id", "title", "posted_at", "total", "pages")


@query("flt15_each_filter", f"WITH {O.POSTINGS} SELECT company_id, count(*) FILTER (active) AS active, count(*) FILTER (NOT active) AS inactive, count(*) FILTER (location ILIKE '%india%') AS india, count(*) FILTER (first_seen_day >= 20) AS recent FROM postings GROUP BY 1")
def each_filter(spark, sf_dir):
    p, out = V.postings(spark, sf_dir), None
    for name, kept in (("active", search.postings(p, active=True)), ("inactive", search.postings(p, active=False)), ("india", search.postings(p, location="india")), ("recent", search.postings(p, first_seen_since=F.lit(20)))):
        one = kept.groupBy("company_id").agg(F.count("*").alias("n")).withColumn("filter", F.lit(name))
        out = one if out is None else out.unionByName(one)
    every = p.select("company_id").distinct()
    sums = [F.coalesce(F.sum(F.when(c("filter") == k, c("n"))), F.lit(0)).alias(k) for k in ("active", "inactive", "india", "recent")]
    return every.join(out, "company_id", "left").groupBy("company_id").agg(*sums)


@query("srt07_export", f"{_ANALYSIS} SELECT p.external_id, p.title, a.score FROM postings p JOIN analysis a USING (company_id, external_id) WHERE a.score >= 25 AND NOT a.hard_filtered ORDER BY a.score DESC, p.external_id")
def export_rows(spark, sf_dir):
    a = _analysis(spark, sf_dir).where("score >= 25 and not hard_filtered").drop("ord")
    return V.postings(spark, sf_dir).join(a, KEY).select("external_id", "title", "score").orderBy(F.desc("score"), "external_id")


@query("qry06_company_detail", f"WITH {O.POSTINGS}, {O.RESULTS}, t AS (SELECT company_id, external_id, posted_at FROM postings WHERE active QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY posted_at DESC, external_id) <= 5), top AS (SELECT company_id, string_agg(external_id, ',' ORDER BY posted_at DESC, external_id) AS postings FROM t GROUP BY 1), last AS (SELECT company_id, max(run) AS run, arg_max(jobs_found, run) AS jobs_found FROM results GROUP BY 1) SELECT company_id, postings, run, jobs_found FROM top LEFT JOIN last USING (company_id)")
def company_detail(spark, sf_dir):
    top = inventory.top_by(V.postings(spark, sf_dir).where("active"), ["company_id"], [F.desc("posted_at"), "external_id"], 5)
    listed = top.groupBy("company_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "external_id"))), lambda x: x["external_id"]), ",").alias("postings"))
    last = V.results(spark, sf_dir).groupBy("company_id").agg(F.max("run").alias("run"), F.max_by("jobs_found", "run").alias("jobs_found"))
    return listed.join(last, "company_id", "left").select("company_id", "postings", "run", "jobs_found")


@query("qry10_probe_board", f"WITH {O.POSTINGS} SELECT company_id, count(*) AS jobs, array_to_string(list_sort(list(DISTINCT source_type)), ',') AS source_types, array_to_string(list_sort(coalesce(list(DISTINCT regexp_extract(job_url, '^https?://[^/]+/[^/?]+')) FILTER (job_url IS NOT NULL), [])), ',') AS endpoints FROM postings GROUP BY 1")
def probe_board(spark, sf_dir):
    listed = lambda x: F.array_join(F.array_sort(F.collect_set(x)), ",")
    return V.postings(spark, sf_dir).groupBy("company_id").agg(F.count("*").alias("jobs"), listed("source_type").alias("source_types"), listed(F.regexp_extract("job_url", "^https?://[^/]+/[^/?]+", 0)).alias("endpoints"))


# --- Boards ------------------------------------------------------------------------------------------------------

_STATE = f"WITH {O.BOARDS}, {O.RESULTS}, j AS (SELECT company_id, sum(jobs_found) AS jobs_found FROM results GROUP BY 1), st AS (SELECT b.*, coalesce(CAST(jobs_found AS BIGINT), 0) AS jobs_found, {O.pick('(rank + 5)', STATUSES)} AS health, {O.pick('(rank + 6)', CATEGORIES)} AS failure_category, {O.pick('(rank + 7)', VERDICTS)} AS verdict, {O.pick('(rank + 4)', V.SOURCES)} AS source_type FROM boards b LEFT JOIN j USING (company_id))"


def _state(spark, sf_dir):
    jobs = V.results(spark, sf_dir).groupBy("company_id").agg(F.sum("jobs_found").alias("jobs_found"))
    b = V.boards(spark, sf_dir).join(jobs, "company_id", "left").withColumn("jobs_found", F.coalesce("jobs_found", F.lit(0)))
    return b.withColumns({"health": V.pick(c("rank") + 5, STATUSES), "failure_category": V.pick(c("rank") + 6, CATEGORIES), "verdict": V.pick(c("rank") + 7, VERDICTS), "source_type": V.pick(c("rank") + 4, V.SOURCES)})


@query("flt18_board_filters", f"{_STATE} SELECT company_id, health FROM st WHERE contains(lower(company_name), 'supplier') AND enabled AND health = 'healthy' AND source_type IN ('greenhouse')")
def board_filters(spark, sf_dir):
    return search.boards(_state(spark, sf_dir), query=" Supplier ", enabled=True, health="healthy", source="greenhouse").select("company_id", "health")


_SEVERITY = "CASE health " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(search.SEVERITY)) + " ELSE 6 END"


@query("srt06_issues", f"{_STATE} SELECT company_id, health, rank FROM st WHERE health IN ('failed', 'suspicious', 'healthy_with_fallback') ORDER BY {_SEVERITY}, rank, company_id LIMIT 8")
def issues(spark, sf_dir):
    s = _state(spark, sf_dir).where(c("health").isin("failed", "suspicious", "healthy_with_fallback"))
    return s.orderBy(search.severity(c("health")), "rank", "company_id").limit(8).select("company_id", "health", "rank")


@query("agg08_health_full", f"{_STATE} SELECT count(*) AS verified, {', '.join(f"count(*) FILTER (health = '{k}') AS {k}" for k in ('healthy', 'healthy_with_fallback', 'suspicious', 'failed'))}, CAST(coalesce(sum(jobs_found), 0) AS BIGINT) AS total_jobs_detected, count(*) FILTER (failure_category = 'network_dns') AS network_dns, count(*) > 0 AND count(*) FILTER (failure_category = 'network_dns') >= greatest(1, floor(count(*) * 0.8)) AS environment_blocked FROM st WHERE enabled")
def health_full(spark, sf_dir):
    return runs.health_summary(_state(spark, sf_dir).where("enabled").withColumnRenamed("health", "status"))


@query("agg08_categories", f"{_STATE} SELECT failure_category, count(*) AS n FROM st WHERE failure_category IS NOT NULL GROUP BY 1")
def categories(spark, sf_dir):
    return _state(spark, sf_dir).where("failure_category is not null").groupBy("failure_category").agg(F.count("*").alias("n"))


@query("agg09_certification", f"{_STATE} SELECT count(*) AS companies, count(*) FILTER (enabled) AS attempted, CAST(coalesce(sum(jobs_found), 0) AS BIGINT) AS total_jobs_found, count(*) FILTER (verdict = 'CERTIFIED') AS certified, count(*) FILTER (verdict IN ('PARTIAL', 'INVALID', 'FAILED', 'BLOCKED')) AS needs_attention, count(*) FILTER (verdict IN ('UNVERIFIED', 'EMPTY_UNVERIFIED')) AS needs_certification FROM st")
def certification(spark, sf_dir):
    return runs.certification_summary(_state(spark, sf_dir))


@query("agg11_dashboard", f"{_STATE} SELECT health, count(*) AS n FROM st WHERE enabled GROUP BY 1")
def dashboard(spark, sf_dir):
    return _state(spark, sf_dir).where("enabled").groupBy("health").agg(F.count("*").alias("n"))


@query("cdc15_good_baseline", f"{_STATE} SELECT company_id, CASE WHEN enabled AND jobs_found > 0 AND health IN ('healthy', 'healthy_with_fallback', 'suspicious') THEN jobs_found ELSE rank END AS jobs_found FROM st")
def good_baseline(spark, sf_dir):
    s = _state(spark, sf_dir)
    return runs.keep_baseline(s.select("company_id", c("rank").alias("jobs_found")), s.where("enabled").select("company_id", "jobs_found", c("health").alias("status")), False)


@query("crt03_recommendations", f"{_STATE} SELECT company_id, CASE verdict WHEN 'CERTIFIED' THEN 'none; keep the source under drift monitoring' WHEN 'BLOCKED' THEN 'use a company-approved API/feed or manual import; do not bypass the restriction' WHEN 'PARTIAL' THEN 'fix pagination/filtering until fetched unique jobs equals the provider-reported total' WHEN 'INVALID' THEN 'replace heuristic extraction with a provider/company-specific adapter before trusting this source' WHEN 'FAILED' THEN 'repair the provider route or create a dedicated adapter; preserve the last certified snapshot' ELSE CASE WHEN rank % 3 = 0 OR rank % 5 = 0 THEN 'identify the authoritative ATS/API and replace generic extraction with a source contract/dedicated adapter' ELSE 'add an independent completeness probe for this provider before marking it certified' END END AS advice FROM st")
def recommendations(spark, sf_dir):
    from tidewheel.operators.health import recommendation

    adapter = F.when(c("rank") % 3 == 0, "AutoSource").otherwise("LeverSource")
    return _state(spark, sf_dir).select("company_id", recommendation(c("verdict"), c("source_type"), F.when(c("rank") % 5 == 0, 2), adapter).alias("advice"))


@query("flt20_india_rows", f"WITH {O.POSTINGS} SELECT external_id, coalesce(upper(trim(location)) = 'IN' OR upper(trim(location)) LIKE '%, IN' OR lower(location) LIKE '%india%', false) AS india FROM postings")
def india_rows(spark, sf_dir):
    found = pcs_in_india(F.array("location"), F.array("location"))
    return V.postings(spark, sf_dir).select("external_id", found.alias("india"))


# --- Mutations and sets ------------------------------------------------------------------------------------------


@query(
    "cdc11_mark_duplicates",
    f"""{_ANALYSIS}, m AS (SELECT company_id, external_id, company_id AS cc, CAST(ord - 1 AS VARCHAR) AS ce FROM postings WHERE ord % 8 = 1)
    SELECT a.external_id, CASE WHEN ce IS NOT NULL THEN 'duplicate' WHEN score >= 50 THEN 'good' ELSE 'low' END AS relevance_status, ce IS NULL AND score >= 50 AS is_relevant, CASE WHEN ce IS NOT NULL THEN 'near_duplicate:' || cc || '/' || ce END AS filter_reason, cc AS duplicate_of_company_id, ce AS duplicate_of_external_id FROM analysis a LEFT JOIN m USING (company_id, external_id)""",
)
def mark_duplicates(spark, sf_dir):
    a = _analysis(spark, sf_dir).select(*KEY, F.when(c("score") >= 50, "good").otherwise("low").alias("relevance_status"), (c("score") >= 50).alias("is_relevant"), F.lit(None).cast("string").alias("filter_reason"))
    marks = V.postings(spark, sf_dir).where("ord % 8 = 1").select(*KEY, c("company_id").alias("canonical_company_id"), (c("ord") - 1).cast("string").alias("canonical_external_id"))
    return runs.mark_duplicates(a, marks).drop("company_id")


_RUNS = "WITH r AS (SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'queued' ELSE 'completed' END AS status, CASE WHEN o_orderkey % 7 = 0 THEN 'timeout' END AS error FROM orders)"


def _runs(spark, sf_dir):
    status = F.when(c("o_orderstatus") == "O", "running").when(c("o_orderstatus") == "P", "queued").otherwise("completed")
    return V.read(spark, sf_dir, "orders").select(c("o_orderkey").alias("run_id"), status.alias("status"), F.when(c("o_orderkey") % 7 == 0, "timeout").alias("error"))


@query("cdc12_interrupt_stale", f"{_RUNS} SELECT run_id, CASE WHEN status IN ('queued', 'running') THEN 'interrupted' ELSE status END AS status, CASE WHEN status IN ('queued', 'running') THEN coalesce(error, 'Server restarted during run') ELSE error END AS error FROM r")
def interrupt_stale(spark, sf_dir):
    return runs.interrupt_stale(_runs(spark, sf_dir))


@query("cdc16_finish_runs", f"{_RUNS} SELECT run_id, CASE WHEN run_id % 3 = 0 THEN CASE WHEN run_id % 2 = 0 THEN 'failed' ELSE 'completed' END ELSE status END AS status, CASE WHEN run_id % 3 = 0 THEN CASE WHEN run_id % 2 = 0 THEN 'no route' END ELSE error END AS error FROM r")
def finish_runs(spark, sf_dir):
    r = _runs(spark, sf_dir)
    return runs.finish(r, r.where("run_id % 3 = 0").select("run_id", F.when(c("run_id") % 2 == 0, "no route").alias("error")))


@query("join08_company_history", f"WITH {O.RESULTS}, n AS (SELECT run, row_number() OVER (ORDER BY run) AS number FROM (SELECT DISTINCT run FROM results)) SELECT company_id, number, jobs_found FROM results JOIN n USING (run)")
def company_history(spark, sf_dir):
    r = V.results(spark, sf_dir)
    # months: a few hundred rows at any size
    months = r.select("run").distinct().agg(F.array_sort(F.collect_list("run")).alias("all")).select(F.posexplode("all").alias("place", "run"))
    return r.join(F.broadcast(months), "run").select("company_id", (c("place") + 1).cast("long").alias("number"), "jobs_found")


@query("join11_coverage", f"WITH {O.POSTINGS}, prov AS (SELECT company_id, external_id FROM postings WHERE ord % 3 != 0), off AS (SELECT company_id, external_id FROM postings WHERE ord % 2 = 0), u AS (SELECT *, 'provider' AS origin FROM prov UNION ALL SELECT *, 'official' FROM (SELECT * FROM off EXCEPT SELECT * FROM prov)) SELECT company_id, external_id, origin FROM u")
def coverage(spark, sf_dir):
    p = V.postings(spark, sf_dir)
    provider, official = p.where("ord % 3 != 0").select(*KEY), p.where("ord % 2 = 0").select(*KEY)
    return inventory.supplement(provider.withColumn("origin", F.lit("provider")), official.withColumn("origin", F.lit("official")), KEY)


@query("set04_union", f"WITH {O.POSTINGS}, u AS (SELECT company_id, job_url, 1 AS pass FROM postings WHERE ord % 2 = 0 UNION ALL SELECT company_id, job_url, 2 FROM postings WHERE ord % 3 = 0) SELECT company_id, job_url, min(pass) AS first_pass, count(*) AS n FROM u GROUP BY ALL")
def union_of_passes(spark, sf_dir):
    p = V.postings(spark, sf_dir)
    passes = p.where("ord % 2 = 0").select("company_id", "job_url", F.lit(1).alias("pass")).unionByName(p.where("ord % 3 = 0").select("company_id", "job_url", F.lit(2).alias("pass")))
    return passes.groupBy("company_id", "job_url").agg(F.min("pass").alias("first_pass"), F.count("*").alias("n"))


@query("rcn06_first_attempt", f"WITH {O.POSTINGS}, a AS (SELECT company_id, ord % 5 AS attempt, count(*) AS n FROM postings WHERE job_url IS NOT NULL AND ord % 5 != 0 GROUP BY ALL) SELECT company_id, min(attempt) AS first_attempt, arg_max(attempt, n * 10 - attempt) AS longest FROM a GROUP BY 1")
def first_attempt(spark, sf_dir):
    a = V.postings(spark, sf_dir).where("job_url is not null and ord % 5 != 0").groupBy("company_id", (c("ord") % 5).alias("attempt")).agg(F.count("*").alias("n"))
    return a.groupBy("company_id").agg(F.min("attempt").alias("first_attempt"), F.max_by("attempt", F.struct("n", -c("attempt"))).alias("longest"))


@query("crt04_stale_links", f"WITH {O.PROBES} SELECT conv_id, turn, NOT (status IN (404, 410) OR (status < 400 AND regexp_matches(coalesce(body, ''), '(?i)\\b(job has been closed|job is no longer available|position has been filled|no longer accepting applications)\\b'))) AS live FROM probes")
def stale_links(spark, sf_dir):
    return V.probes(spark, sf_dir).select("conv_id", "turn", T.live_link(c("status"), c("body")).alias("live"))


# --- URLs --------------------------------------------------------------------------------------------------------

_URLS = f"WITH u AS (SELECT event_id, {O.pick('event_id', CAREERS)} AS base, {O.pick('event_id', DETAILS)} AS detail, CASE WHEN event_id % 10 != 9 THEN CAST(event_id AS VARCHAR) END AS job FROM events), h AS (SELECT *, regexp_extract(base, '^https://([^/?#]*)', 1) AS host FROM u)"


def _urls(spark, sf_dir):
    k = c("event_id")
    return V.read(spark, sf_dir, "events").select(k, V.pick(k, CAREERS).alias("base"), V.pick(k, DETAILS).alias("detail"), F.when(k % 10 != 9, k.cast("string")).alias("job"))


@query("scl12_canonical_url", f"""{_URLS} SELECT event_id, CASE WHEN job IS NULL THEN NULL WHEN base LIKE 'https://careers.oracle.com%' THEN 'https://careers.oracle.com/en/sites/jobsearch/job/' || job WHEN host = 'eeho.fa.us2.oraclecloud.com' THEN 'https://eeho.fa.us2.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/job/' || job
  WHEN host = 'acme.eightfold.ai' THEN 'https://acme.eightfold.ai/careers/job/' || job WHEN host = 'careers.swiggy.com' THEN 'https://careers.swiggy.com/#/careers?reqid=' || job END AS url FROM h""")
def canonical_url(spark, sf_dir):
    return _urls(spark, sf_dir).select("event_id", T.canonical_job_url(c("base"), c("job")).alias("url"))


@query("scl16_job_id", f"{_URLS} SELECT event_id, ({O.array(['123', '44-2', '77', 'ab-c', '99', DETAILS[5], '5'])})[CAST(event_id % 7 AS INTEGER) + 1] AS job_id FROM u")
def job_id(spark, sf_dir):
    return _urls(spark, sf_dir).select("event_id", T.job_id_from_url(c("detail")).alias("job_id"))


@query("dsc01_board_identity", f"{_URLS} SELECT event_id, ({O.array(['greenhouse', 'greenhouse', 'lever', 'ashby', 'smartrecruiters', 'workday', 'eightfold', '', 'oracle', '', '', ''])})[CAST(event_id % 12 AS INTEGER) + 1] AS provider, ({O.array(['acme', 'acme', 'acme', 'acme', 'Acme', 'acme', 'acme', '', 'CX_1', '', '', ''])})[CAST(event_id % 12 AS INTEGER) + 1] AS tenant FROM u")
def board_identity(spark, sf_dir):
    found = _urls(spark, sf_dir).select("event_id", T.board_identity(c("base")).alias("b"))
    return found.select("event_id", F.coalesce("b.provider", F.lit("")).alias("provider"), F.coalesce("b.tenant", F.lit("")).alias("tenant"))


@query("scl32_since_date", "SELECT event_id, CAST(ts AS DATE) - CAST(event_id % 30 AS INTEGER) AS since FROM events")
def since_date(spark, sf_dir):
    return V.read(spark, sf_dir, "events").select("event_id", F.date_sub(F.to_date("ts"), (c("event_id") % 30).cast("int")).alias("since"))


@query("set06_outlinks", "WITH l AS (SELECT page_id, unnest(x) AS url, generate_subscripts(x, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?i)(?:href|src)=[\"'']?([^\"''\\s>]+)', 1) AS x FROM pages)) SELECT page_id, url, min(pos) AS pos FROM l GROUP BY ALL")
def outlinks(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit("(?i)(?:href|src)=[\"']?([^\"'\\s>]+)"), 1)
    links = V.pages(spark, sf_dir).select("page_id", F.posexplode(found).alias("pos", "url"))
    return links.groupBy("page_id", "url").agg((F.min("pos") + 1).cast("long").alias("pos"))


