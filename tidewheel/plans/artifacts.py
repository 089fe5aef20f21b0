"""Registered queries over stored artifacts, streams' states, merged records and searches with totals, each with the SQL that checks it."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from tidewheel.functions import predicates as R
from tidewheel.operators import health, inventory, merging, pages, reconcile, relevance, search
from tidewheel.operators.deliveries import Deliveries
from tidewheel.operators.stored import files_key, shared_root
from tidewheel.plans import oracle as O
from tidewheel.plans import views as V
from tidewheel.plans.queries import _EVERY, _POLICY, KEY, _analyses, c, query
from tidewheel.plans.reports import _DELIVERED, _FROZEN
from tidewheel.plans.site_pages import _sql, job_pages
from tidewheel.sources import sinks
from tidewheel.streaming import merge as streaming


# --- Artifacts of runs -------------------------------------------------------------------------------------------


def _named(spark, sf_dir):
    """Every content of a key with what its posting shows."""
    shown = V.postings(spark, sf_dir).select(*KEY, "company_name", "title", "location", "description", "job_url")
    return V.snapshots(spark, sf_dir).select(*KEY, "content").distinct().join(shown, KEY, "left")


def _finalized(spark, sf_dir, name: str = "finalized") -> Deliveries:
    """All runs of the snapshots finalized into a store of the tables' files: queries after the first find its manifests."""
    s = V.snapshots(spark, sf_dir).where("run is not null")
    day = c("run").cast("string")
    runs = s.select(day.alias("run")).distinct().select("run", c("run").alias("created_at"), F.lit(None).cast("string").alias("started_at"))
    key = "".join(files_key(spark, f"{sf_dir}/{t}.parquet") for t in ("events", "documents"))
    store = Deliveries(spark, f"{shared_root(spark)}/{name}-{hashlib.md5(key.encode()).hexdigest()}")
    # only postings that a run has seen are frozen, so no others are scored
    seen = V.postings(spark, sf_dir).join(s.select(*KEY).distinct(), KEY, "left_semi")
    analysis = relevance.apply_location_policy(relevance.score(seen))
    store.finalize(runs, inventory.replay(s), analysis, _named(spark, sf_dir), "2026-01-01T00:00:00Z")
    return store


@query(
    "evt02_artifacts",
    f"""{_FROZEN} SELECT CAST(run AS VARCHAR) AS run, count(*) FILTER (observed) AS snapshot_jobs, count(*) FILTER (event = 'new') AS jobs_new, count(*) FILTER (event = 'changed') AS jobs_changed, count(*) FILTER (event = 'unchanged') AS jobs_unchanged,
    count(*) FILTER (event = 'closed') AS jobs_closed, count(*) FILTER (event = 'new' AND ok) AS new_relevant, count(*) FILTER (event = 'changed' AND ok) AS changed_relevant, count(*) FILTER (event IN ('new', 'changed') AND ok) AS ai_input_count FROM frozen WHERE run IS NOT NULL GROUP BY 1""",
)
def artifacts(spark, sf_dir):
    return _finalized(spark, sf_dir).summaries().drop("baseline_relevant")


@query(
    "evt02_payload",
    f"""{_FROZEN} SELECT CAST(run AS VARCHAR) AS run, row_number() OVER (PARTITION BY run ORDER BY coalesce(f.relevance_score, -1) DESC, p.company_name NULLS FIRST, p.title NULLS FIRST, company_id, external_id) AS place, company_id, external_id, event
    FROM frozen f LEFT JOIN postings p USING (company_id, external_id) WHERE event IN ('new', 'changed') AND ok AND run IS NOT NULL""",
)
def payload(spark, sf_dir):
    return _finalized(spark, sf_dir).jobs().select("run", "place", *KEY, "event")


@query(
    "dlv01_artifacts",
    f"{_DELIVERED}, n AS (SELECT run, count(*) AS ai_input_count FROM delivered GROUP BY 1), b AS (SELECT run, count(*) FILTER (observed AND ok) AS baseline_relevant FROM frozen WHERE run IS NOT NULL GROUP BY 1) SELECT CAST(b.run AS VARCHAR) AS run, CASE WHEN b.run = (SELECT min(run) FROM b) THEN 'baseline' ELSE 'incremental' END AS delivery_mode, 3 AS schema_version, baseline_relevant, coalesce(ai_input_count, 0) AS ai_input_count FROM b LEFT JOIN n USING (run)",
)
def delivered_artifacts(spark, sf_dir):
    store = _finalized(spark, sf_dir, "delivered")
    return store.deliver(_named(spark, sf_dir)).select("run", "delivery_mode", "schema_version", "baseline_relevant", "ai_input_count")


@query(
    "qry03_run_page",
    f"""{_FROZEN}, one AS (SELECT f.*, p.company_name, p.title, p.location FROM frozen f LEFT JOIN postings p USING (company_id, external_id) WHERE run = (SELECT max(run) FROM frozen) AND coalesce(f.relevance_score, 0) >= 0 AND p.title ILIKE '%engineer%')
    SELECT company_id, external_id, event, (SELECT count(*) FROM one) AS total FROM one ORDER BY CASE event WHEN 'new' THEN 0 WHEN 'changed' THEN 1 WHEN 'closed' THEN 2 ELSE 3 END, coalesce(relevance_score, -1) DESC, company_name, title, company_id, external_id LIMIT 50""",
)
def run_page(spark, sf_dir):
    store = _finalized(spark, sf_dir)
    rows = store.frozen().join(V.postings(spark, sf_dir).select(*KEY, "company_name", "title", "location"), KEY, "left")
    newest = store.manifest().agg(F.max("run")).first()[0]
    return search.run_page(rows, newest, query="engineer", min_score=0).select(*KEY, "event", "total")


@query("qry04_historical_job", f"{_FROZEN} SELECT CAST(run AS VARCHAR) AS run, event, relevance_score, first_run FROM frozen JOIN vers USING (company_id, external_id, content) WHERE company_id = 'src1' AND external_id = '1' AND run IS NOT NULL")
def historical_job(spark, sf_dir):
    """Every run's row of one posting, by its key."""
    first = V.snapshots(spark, sf_dir).groupBy(*KEY, "content").agg(F.min("run").alias("first_run"))
    found = search.lookup(_finalized(spark, sf_dir).frozen(), company_id="src1", external_id="1")
    return found.join(first, [*KEY, "content"]).select("run", "event", "relevance_score", "first_run")


# --- Searches of the stored analysis -----------------------------------------------------------------------------


def _joined(spark, sf_dir):
    p = V.postings(spark, sf_dir).drop("ord", "source_type", "job_url")
    return p.join(_analyses(spark, sf_dir).drop("ord", "company_name", "title", "active", "last_change_type", "posted_at", "first_seen_day", "location_status"), KEY, "left")


@query(
    "qry02_relevance_page",
    f"""{_POLICY}, f AS (SELECT * FROM analysed WHERE active AND normalized_location ILIKE '%india%' AND (title ILIKE '%engineer%' OR description ILIKE '%engineer%' OR company_name ILIKE '%engineer%' OR location ILIKE '%engineer%') AND relevance_score >= 20 AND last_change_type = 'new' AND CAST(posted_at AS DATE) >= DATE '2026-02-01')
    SELECT company_id, external_id, relevance_score, (SELECT count(*) FROM f) AS total FROM f ORDER BY is_relevant DESC, relevance_score DESC, company_name, title, company_id, external_id LIMIT 50""",
)
def relevance_page(spark, sf_dir):
    return search.relevance_page(_joined(spark, sf_dir), query="engineer", min_score=20, change_type="new", posted_since="2026-02-01").select(*KEY, "relevance_score", "total")


@query(
    "qry02_relevant_total",
    f"{_POLICY} SELECT role_family, relevance_status, count(*) AS n FROM analysed WHERE active AND normalized_location ILIKE '%india%' AND first_seen_day >= 10 GROUP BY ALL",
)
def relevant_total(spark, sf_dir):
    return search.relevance(_joined(spark, sf_dir), first_seen_since=F.lit(10)).groupBy("role_family", "relevance_status").agg(F.count("*").alias("n"))


@query(
    "qry08_all_figures",
    f"""{_POLICY}, a AS (SELECT * FROM analysed WHERE active), s AS (SELECT string_agg(relevance_status || '=' || n, ',' ORDER BY relevance_status) AS statuses FROM (SELECT relevance_status, count(*) AS n FROM a GROUP BY 1)),
    r AS (SELECT string_agg(reason || '=' || n, ',' ORDER BY reason) AS filter_reasons FROM (SELECT coalesce(filter_reason, 'unknown') AS reason, count(*) AS n FROM a WHERE relevance_status = 'filtered' GROUP BY 1))
    SELECT count(*) AS active_jobs, count(*) AS analyzed, CAST(0 AS BIGINT) AS pending, count(*) FILTER (is_relevant) AS relevant_jobs, count(*) FILTER (last_change_type IN ('new', 'changed')) AS new_changed, count(*) FILTER (is_relevant AND last_change_type IN ('new', 'changed')) AS relevant_new_changed,
      (SELECT statuses FROM s) AS statuses, (SELECT filter_reasons FROM r) AS filter_reasons FROM a""",
)
def all_figures(spark, sf_dir):
    listed = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias(m)
    return search.relevance_stats(_joined(spark, sf_dir)).select("active_jobs", "analyzed", "pending", "relevant_jobs", "new_changed", "relevant_new_changed", listed("statuses"), listed("filter_reasons"))


# --- The state of a stream ---------------------------------------------------------------------------------------


@query(
    "str01_merged_state",
    f"""WITH RECURSIVE {O.SNAPSHOTS}, sizes AS (SELECT company_id, run, count(*) AS found FROM snapshots WHERE run IS NOT NULL GROUP BY ALL), days AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY run) AS i FROM sizes),
    met AS (SELECT company_id, external_id, content, run, i, lag(i) OVER (PARTITION BY company_id, external_id ORDER BY run) AS prev, lag(content) OVER (PARTITION BY company_id, external_id ORDER BY run) AS was FROM snapshots JOIN days USING (company_id, run)),
    walk AS (SELECT company_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS had, CAST(0 AS BIGINT) AS since FROM days WHERE i = 1
      UNION ALL SELECT w.company_id, d.i, CASE WHEN w.had > 0 AND d.found < w.had * (1 - 0.8) THEN w.had + (SELECT count(*) FROM met m WHERE m.company_id = d.company_id AND m.i = d.i AND coalesce(m.prev, -1) < w.since) ELSE d.found END,
        CASE WHEN w.had > 0 AND d.found < w.had * (1 - 0.8) THEN w.since ELSE d.i END FROM walk w JOIN days d ON d.company_id = w.company_id AND d.i = w.i + 1),
    ends AS (SELECT company_id, max(since) AS since FROM walk GROUP BY 1),
    num AS (SELECT *, CAST(date_diff('day', DATE '1970-01-01', run) AS VARCHAR) AS n FROM met)
    SELECT company_id, external_id, arg_max(content, run) AS content_hash, arg_min(n, run) AS first_seen, arg_max(n, run) AS last_seen, arg_max(n, run) FILTER (was IS NULL OR was != content) AS changed_at,
      max(i) >= any_value(since) AS active, arg_max(CASE WHEN was IS NULL THEN 'new' WHEN was != content THEN 'changed' ELSE 'unchanged' END, run) AS last_change_type
    FROM num JOIN ends USING (company_id) GROUP BY ALL""",
)
def merged_state(spark, sf_dir):
    """All runs of all boards merged as one batch."""
    batch = V.snapshots(spark, sf_dir).withColumn("run", F.unix_date("run"))
    return streaming.merge_runs(spark.createDataFrame([], streaming.STATE), batch)


# --- Records made one --------------------------------------------------------------------------------------------


@query(
    "rcn01_field_merge",
    """WITH r AS (SELECT user_id AS k, event_id AS n, [event_type, event_type || (event_id % 3)] AS tags, repeat(chr(CAST(97 + event_id % 5 AS INTEGER)), CAST(event_id % 4 AS INTEGER)) AS t, CASE WHEN event_id % 3 != 0 THEN event_id END AS v FROM events),
    u AS (SELECT k, unnest(tags) AS tag, n, unnest(range(2)) AS i FROM r), first AS (SELECT k, tag, min(n * 2 + i) AS pos FROM u GROUP BY ALL)
    SELECT k, (SELECT string_agg(tag, ',' ORDER BY pos) FROM first f WHERE f.k = r.k) AS tags, arg_max(t, length(t) * 1000000000 + n) FILTER (t != '') AS t, arg_max(v, n) FILTER (v IS NOT NULL) AS v, count(*) AS passes FROM r GROUP BY k""",
)
def field_merge(spark, sf_dir):
    e = V.read(spark, sf_dir, "events")
    k = c("event_id")
    t = F.repeat(F.char(97 + k % 5), (k % 4).cast("int"))
    rows = e.select(c("user_id").alias("k"), k.alias("n"), F.array("event_type", F.concat("event_type", (k % 3).cast("string"))).alias("tags"), t.alias("t"), F.when(k % 3 != 0, k).alias("v"))
    merged = merging.merge_passes(rows, ["k"], "n", ["tags"], ["t"], ["v"])
    return merged.withColumn("tags", F.array_join("tags", ","))


@query(
    "src28_hydrated",
    f"""WITH {O.POSTINGS} SELECT external_id, CASE WHEN ord % 2 = 0 THEN left(title, 3) WHEN ord % 3 = 0 THEN 'detail' WHEN ord % 5 = 0 THEN 'page' END AS description, CASE WHEN ord % 2 = 1 AND ord % 3 = 0 THEN 'D' || title ELSE title END AS title,
      CASE WHEN ord % 2 = 1 THEN ord % 3 = 0 OR ord % 5 = 0 END AS hydrated, CASE WHEN ord % 2 = 1 THEN CASE WHEN ord % 3 = 0 THEN 'position_details' WHEN ord % 5 = 0 THEN 'public_job_page' ELSE 'missing' END END AS text_source FROM postings""",
)
def hydrated(spark, sf_dir):
    """Every second posting lacks its text; a third of those has a detail row, a fifth of the others a public page."""
    p = V.postings(spark, sf_dir).select("external_id", "ord", "title", F.when(c("ord") % 2 == 0, F.substring("title", 1, 3)).alias("description"))
    detail = p.where("ord % 3 = 0").select("external_id", F.concat(F.lit("D"), "title").alias("title"), F.lit("detail").alias("description"))
    public = p.where("ord % 5 = 0").select("external_id", F.lit("page").alias("description"))
    return merging.hydrate(p, detail, public, ["external_id"], c("ord") % 2 == 1, ["title", "description"]).drop("ord")


@query("src27_details", _sql("SELECT page_id, CASE WHEN page_id % 3 != 1 THEN role || ' LD' ELSE 'Listed' END AS title, CASE WHEN page_id % 3 != 1 THEN town || ', IN' END AS location, CASE WHEN page_id % 3 != 1 THEN 'jsonld' ELSE 'main_text' END AS source FROM p"))
def details(spark, sf_dir):
    table = job_pages(spark, sf_dir)
    listed = table.select(c("page_id").alias("record_id"), "page_id", F.lit("Listed").alias("title"), "url")
    return merging.supplement_details(listed, pages.jsonld(table), pages.main_text(table)).select(c("record_id").alias("page_id"), "title", "location", "source")


@query("rcn06_attempts", f"WITH {O.POSTINGS}, a AS (SELECT company_id, ord % 5 AS attempt, count(*) FILTER (ord % 5 != 0 AND job_url IS NOT NULL) AS rows FROM postings GROUP BY ALL) SELECT company_id, coalesce(min(attempt) FILTER (rows > 0), min(attempt)) AS first_filled, arg_max(attempt, rows * 10 - attempt) AS longest FROM a GROUP BY 1")
def attempts(spark, sf_dir):
    a = V.postings(spark, sf_dir).groupBy("company_id", (c("ord") % 5).alias("attempt")).agg(F.count_if((c("ord") % 5 != 0) & c("job_url").isNotNull()).alias("rows"))
    first = merging.best_attempt(a, ["company_id"], "first").select("company_id", c("attempt").alias("first_filled"))
    return first.join(merging.best_attempt(a, ["company_id"]).select("company_id", c("attempt").alias("longest")), "company_id")


# --- Reports -----------------------------------------------------------------------------------------------------


@query(
    "snk03_last_good",
    f"WITH {O.RESULTS}, d AS (SELECT *, dense_rank() OVER (ORDER BY run) AS i FROM results) SELECT company_id, CAST(arg_max(jobs_found, run) AS BIGINT) AS jobs_found FROM d WHERE i <= 2 AND jobs_found > 0 GROUP BY 1",
)
def last_good_counts(spark, sf_dir):
    """The last good counts after the health reports of the first two months."""
    r = V.results(spark, sf_dir)
    root = f"{shared_root(spark)}/health-{uuid.uuid4().hex}"
    for (month,) in r.select("run").distinct().orderBy("run").limit(2).collect():
        rows = r.where(c("run") == F.lit(month)).select(c("company_id").alias("id"), F.lit("healthy").alias("status"), "jobs_found")
        sinks.write_health(rows, root, f"{month}T00:00:00Z")
    return sinks.read_baseline(spark, root)


# --- Evidence ----------------------------------------------------------------------------------------------------

_PASSES = f"WITH {O.SNAPSHOTS}, r AS (SELECT company_id, run, external_id FROM snapshots UNION ALL SELECT company_id, run, external_id FROM snapshots WHERE CAST(external_id AS BIGINT) % 7 = 0)"


@query(
    "rcn02_pass_audit",
    f"""{_PASSES}, n AS (SELECT company_id, run, external_id, count(*) AS c FROM r GROUP BY ALL), f AS (SELECT company_id, external_id, min(run) AS run FROM n GROUP BY ALL),
    p AS (SELECT company_id, run, sum(c)::BIGINT AS rows, count(*) AS unique_ids, sum(c - 1)::BIGINT AS duplicate_rows, count(*) FILTER (c > 1) AS duplicate_ids, (SELECT count(*) FROM f WHERE f.company_id = n.company_id AND f.run = n.run) AS new_ids,
      (SELECT count(*) FROM f WHERE f.company_id = n.company_id AND f.run <= n.run) - count(*) AS prior_ids_missing FROM n GROUP BY company_id, run)
    SELECT *, coalesce((SELECT bool_or(q.new_ids > 0 OR q.prior_ids_missing > 0) FROM p q WHERE q.company_id = p.company_id AND q.run > (SELECT min(z.run) FROM p z WHERE z.company_id = p.company_id)), false) AS mutated FROM p""",
)
def pass_audit(spark, sf_dir):
    """Every run of a board as a pass over it, a seventh of the ids twice."""
    s = V.snapshots(spark, sf_dir).select("company_id", "run", "external_id")
    return reconcile.pass_audit(s.unionByName(s.where("cast(external_id as long) % 7 = 0")))


@query(
    "rcn05_trusted_attempt",
    f"""WITH {O.POSTINGS}, a AS (SELECT company_id, ord % 4 AS attempt, CASE ord % 4 WHEN 2 THEN 'greenhouse' WHEN 3 THEN 'html' ELSE 'browser' END AS kind, count(*) FILTER (job_url IS NOT NULL) AS usable, count(*) AS rows FROM postings WHERE NOT (company_id LIKE '%1' AND ord % 4 = 2) GROUP BY ALL)
    SELECT company_id, attempt, kind, usable, rows, kind = 'greenhouse' AS trusted FROM a QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY kind != 'greenhouse', usable DESC, usable / rows DESC, rows DESC, attempt) = 1""",
)
def trusted_attempt(spark, sf_dir):
    p = V.postings(spark, sf_dir).where(~(c("company_id").like("%1") & (c("ord") % 4 == 2)))
    attempt = c("ord") % 4
    kind = F.when(attempt == 2, "greenhouse").when(attempt == 3, "html").otherwise("browser")
    return reconcile.best_of(p.groupBy("company_id", attempt.alias("attempt"), kind.alias("kind")).agg(F.count_if(c("job_url").isNotNull()).alias("usable"), F.count("*").alias("rows")))


@query(
    "rcn04_certificate",
    f"""{_EVERY}, i AS (SELECT company_id, run, external_id FROM b UNION SELECT company_id, run, external_id FROM p UNION SELECT company_id, run, external_id FROM a),
    m AS (SELECT i.*, CAST(i.external_id AS BIGINT) AS x, (company_id, run, external_id) IN (SELECT (company_id, run, external_id) FROM b) AS bef, (company_id, run, external_id) IN (SELECT (company_id, run, external_id) FROM p) AS made, (company_id, run, external_id) IN (SELECT (company_id, run, external_id) FROM a) AS aft FROM i),
    g AS (SELECT company_id, run, count(*) FILTER (bef AND aft) AS stable, count(*) FILTER (bef AND aft AND NOT made) AS missing, count(*) FILTER (made AND NOT (bef AND aft)) AS extra, count(*) FILTER (x % 3 = 0 AND aft AND NOT made) AS missing_witness, count(*) FILTER (made AND x % 2 = 0) AS target, count(*) FILTER (made AND x % 2 = 0 AND x % 5 != 0) AS described FROM m GROUP BY ALL)
    SELECT *, CASE WHEN missing = 0 AND missing_witness = 0 AND target = described THEN 'CERTIFIED' ELSE 'FAILED' END AS verdict FROM g""",
)
def certificate(spark, sf_dir):
    n = c("external_id").cast("long")
    marks = health.window_marks(V.snapshots(spark, sf_dir), "company_id", "external_id", "run").withColumns({"witness": n % 3 == 0, "in_target": n % 2 == 0, "has_text": n % 5 != 0})
    return reconcile.window_certificate(marks, ["company_id", "run"])


@query("flt11_visible_board", "SELECT page_id, page_id % 4 IN (0, 3) AS empty_board FROM pages")
def visible_board(spark, sf_dir):
    """A marker in a script doesn't count, one across tags and one far behind styles do."""
    k = c("page_id")
    said = F.when(k % 4 == 0, "<p>There are <b>no open</b> roles</p>").when(k % 4 == 1, "<script>s = 'no open roles'</script>").when(k % 4 == 3, F.concat(F.lit("<style>"), F.repeat(F.lit("p{} "), 20000), F.lit("</style>no current vacancies"))).otherwise("<p>many</p>")
    text = pages.visible_text(V.pages(spark, sf_dir).select("page_id", F.concat(F.lit("<html>"), said, c("html")).alias("html")))
    return text.select("page_id", R.empty_board(c("text")).alias("empty_board"))
