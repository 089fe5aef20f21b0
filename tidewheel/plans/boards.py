"""Registered queries over boards, their configuration, results and listings, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.functions import profile as P
from tidewheel.operators import boards, discovery, health, inventory, pages, relevance, runs, search
from tidewheel.plans import oracle as O
from tidewheel.plans import views as V
from tidewheel.plans.queries import _POLICY, KEY, _analyses, c, query
from tidewheel.plans.reports import _STATE, _state
from tidewheel.sources import landing


def say(*parts):
    """Columns and texts joined."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


# --- Configuration -----------------------------------------------------------------------------------------------

_SOURCES = ['{"type": "greenhouse", "board_token": "t"}', '{"type": "workday", "host": "h"}', '{"type": "lever", "site": ""}', '{"type": "rss"}', '{"type": "auto"}', "null"]


def config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as rows of a configuration: (ord, body), many of them wrong in one way or more."""
    k = c("s_suppkey")
    n = k.cast("string")
    ident = F.when(k % 11 == 9, say('"id": "src', (k - 1).cast("string"), '", ')).when(k % 11 == 10, "").otherwise(say('"id": "src', n, '", '))
    name = F.when(k % 17 == 3, '"name": "", ').otherwise(say('"name": "', c("s_name"), '", '))
    url = F.when(k % 7 == 0, say('"career_url": "careers.example/', n, '", ')).when(k % 7 == 1, "").when(k % 7 == 2, '"career_url": null, ').otherwise(say('"career_url": "https://careers.example/', n, '", '))
    enabled = F.when(k % 5 == 0, '"enabled": "yes", ').when(k % 5 == 1, "").otherwise('"enabled": true, ')
    rank = F.when(k % 9 == 0, '"rank": -1, ').when(k % 9 == 1, '"rank": "7", ').otherwise(say('"rank": ', (F.floor(k / 2) * 2 + 2).cast("string"), ", "))
    return V.read(spark, sf_dir, "supplier").select((k + 1).alias("ord"), say("{", ident, name, url, enabled, rank, '"source": ', V.pick(k, _SOURCES), "}").alias("body"))


@query(
    "qc01_config_checks",
    """WITH f AS (SELECT s_suppkey AS k, s_suppkey + 1 AS ord, CASE s_suppkey % 11 WHEN 10 THEN NULL WHEN 9 THEN 'src' || (s_suppkey - 1) ELSE 'src' || s_suppkey END AS company_id, CASE WHEN s_suppkey % 9 > 1 THEN s_suppkey // 2 * 2 + 2 END AS rank FROM supplier),
    g AS (SELECT *, coalesce(company_id, 'row ' || ord) AS who, row_number() OVER (PARTITION BY company_id ORDER BY ord) AS nth_id, row_number() OVER (PARTITION BY rank ORDER BY ord) AS nth_rank FROM f)
    SELECT ord, 0 AS place, company_id, 'row ' || ord || ': missing id' AS error FROM g WHERE company_id IS NULL
    UNION ALL SELECT ord, 1, company_id, 'row ' || ord || ': missing name' FROM g WHERE k % 17 = 3
    UNION ALL SELECT ord, 2, company_id, 'row ' || ord || ': missing career_url' FROM g WHERE k % 7 IN (1, 2)
    UNION ALL SELECT ord, 3, company_id, 'row ' || ord || ': missing source' FROM g WHERE k % 6 = 5
    UNION ALL SELECT ord, 4, company_id, 'duplicate id: ' || company_id FROM g WHERE company_id IS NOT NULL AND nth_id > 1
    UNION ALL SELECT ord, 5, company_id, who || ': enabled must be true/false' FROM g WHERE k % 5 = 0
    UNION ALL SELECT ord, 6, company_id, who || ': rank must be a positive integer' FROM g WHERE k % 9 < 2
    UNION ALL SELECT ord, 7, company_id, 'duplicate rank: ' || rank FROM g WHERE rank IS NOT NULL AND nth_rank > 1
    UNION ALL SELECT ord, 8, company_id, who || ': invalid career_url' FROM g WHERE k % 7 IN (0, 2)
    UNION ALL SELECT ord, 9, company_id, who || ': unsupported source type ' || CASE k % 6 WHEN 3 THEN '''rss''' ELSE 'None' END FROM g WHERE k % 6 IN (3, 5)
    UNION ALL SELECT ord, 11, company_id, who || ': source lever requires site' FROM g WHERE k % 6 = 2
    UNION ALL SELECT ord, 15, company_id, who || ': source workday requires tenant' FROM g WHERE k % 6 = 1
    UNION ALL SELECT ord, 16, company_id, who || ': source workday requires site' FROM g WHERE k % 6 = 1""",
)
def config_checks(spark, sf_dir):
    return boards.config_errors(config(spark, sf_dir))


# --- States of boards and runs -----------------------------------------------------------------------------------

_FOUND = ["healthy", "suspicious", "failed", "healthy_with_fallback"]


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of verify runs (even months) and fetch runs, some recorded twice."""
    n = c("jobs_found")
    r = V.results(spark, sf_dir).select("company_id", c("run").cast("string").alias("run_id"), F.when(F.month("run") % 2 == 0, "verify").otherwise("fetch").alias("run_type"), n)
    again = r.where(n % 3 == 0).withColumns({"jobs_found": n + 1, "created_at": say(c("run_id"), " 2")})
    both = r.withColumn("created_at", say(c("run_id"), " 1")).unionByName(again)
    return both.withColumns({"status": V.pick(n, _FOUND), "new_jobs": F.when(n % 5 != 0, n % 4), "existing_jobs": n - n % 4})


_RESULTS = f"""{O.RESULTS}, r AS (SELECT company_id, CAST(run AS VARCHAR) AS run_id, CASE WHEN month(run) % 2 = 0 THEN 'verify' ELSE 'fetch' END AS run_type, CASE WHEN jobs_found % 3 = 0 THEN jobs_found + 1 ELSE jobs_found END AS jobs_found FROM results),
  found AS (SELECT *, {O.pick("jobs_found", _FOUND)} AS status, CASE WHEN jobs_found % 5 != 0 THEN jobs_found % 4 ELSE 0 END AS new_jobs, jobs_found - jobs_found % 4 AS existing_jobs FROM r)"""


@query(
    "agg04_run_rollup",
    f"""WITH {_RESULTS} SELECT run_id, count(*) AS completed_companies, count(*) FILTER (status = 'healthy') AS healthy, count(*) FILTER (status = 'healthy_with_fallback') AS fallback, count(*) FILTER (status = 'suspicious') AS suspicious, count(*) FILTER (status = 'failed') AS failed,
    CAST(sum(jobs_found) AS BIGINT) AS jobs_found, CAST(sum(new_jobs) AS BIGINT) AS jobs_new, CAST(sum(existing_jobs) AS BIGINT) AS jobs_updated FROM found GROUP BY 1""",
)
def run_rollup(spark, sf_dir):
    return runs.rollup(results(spark, sf_dir))


@query(
    "join09_company_state",
    f"""WITH {O.BOARDS}, {O.POSTINGS}, {_RESULTS}, latest AS (SELECT company_id, run_type, max(run_id) AS run, arg_max(jobs_found, run_id) AS jobs, arg_max(status, run_id) AS status FROM found GROUP BY ALL), counts AS (SELECT company_id, count(*) AS total, count(*) FILTER (active) AS active FROM postings GROUP BY 1)
    SELECT b.company_id, CASE WHEN NOT enabled THEN 'disabled' ELSE coalesce(v.status, 'never_verified') END AS resolved_health, v.run AS verify_run, v.jobs AS verify_jobs, f.run AS fetch_run, f.jobs AS fetch_jobs, coalesce(active, 0) AS active_jobs, coalesce(total, 0) AS total_jobs
    FROM boards b LEFT JOIN latest v ON v.company_id = b.company_id AND v.run_type = 'verify' LEFT JOIN latest f ON f.company_id = b.company_id AND f.run_type = 'fetch' LEFT JOIN counts n ON n.company_id = b.company_id""",
)
def company_state(spark, sf_dir):
    s = boards.company_state(V.boards(spark, sf_dir), V.postings(spark, sf_dir), results(spark, sf_dir))
    of = lambda kind, name: [c(f"{kind}_result.run_id").alias(f"{name}_run"), c(f"{kind}_result.jobs_found").alias(f"{name}_jobs")]
    return s.select("company_id", "resolved_health", *of("health", "verify"), *of("fetch", "fetch"), "active_jobs", "total_jobs")


@query(
    "qry05_health_list",
    f"""WITH {O.BOARDS}, {_RESULTS}, latest AS (SELECT company_id, arg_max(status, run_id) AS status FROM found WHERE run_type = 'verify' GROUP BY 1) SELECT company_id, company_name, coalesce(status, 'never_verified') AS health FROM boards LEFT JOIN latest USING (company_id) WHERE enabled AND coalesce(status, 'never_verified') = 'suspicious' AND contains(lower(company_name), 'supplier')""",
)
def health_list(spark, sf_dir):
    s = boards.company_state(V.boards(spark, sf_dir), V.postings(spark, sf_dir), results(spark, sf_dir)).withColumn("health", c("resolved_health"))
    return search.boards(s, query="supplier", enabled=True, health="suspicious").select("company_id", "company_name", "health")


@query(
    "agg10_scan_summary",
    f"""{_STATE}, {_POLICY.removeprefix("WITH ")}, a AS (SELECT count(*) FILTER (health = 'failed') AS failed, count(*) FILTER (health = 'suspicious') AS suspicious FROM st),
    b AS (SELECT count(*) AS active_jobs, count(relevance_status) AS analyzed, count(*) FILTER (relevance_status IS NULL) AS pending, count(*) FILTER (is_relevant) AS relevant_jobs, count(*) FILTER (last_change_type IN ('new', 'changed')) AS new_changed, count(*) FILTER (is_relevant AND last_change_type IN ('new', 'changed')) AS relevant_new_changed FROM analysed WHERE active) SELECT * FROM a, b""",
)
def scan_summary(spark, sf_dir):
    return runs.scan_summary(_state(spark, sf_dir), search.relevance_stats(_analyses(spark, sf_dir)).drop("statuses", "filter_reasons"))


_HEADERS = """WITH o AS (SELECT o_orderkey AS run_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderkey % 4 != 0 AS known, o_orderkey % 8 = 0 AS begun, o_orderkey % 3 = 0 AS ended, CASE WHEN o_orderkey % 2 = 0 THEN 'no route' END AS bad FROM orders)"""


@query(
    "cdc16_run_headers",
    f"""{_HEADERS} SELECT run_id, CASE WHEN ended THEN CASE WHEN bad IS NULL THEN 'completed' ELSE 'failed' END WHEN begun THEN 'running' WHEN known THEN 'interrupted' ELSE 'queued' END AS status, CASE WHEN known THEN 'all' ELSE 'selected' END AS scope, CASE WHEN known THEN '{{"workers": 4}}' ELSE '{{}}' END AS settings,
    CASE WHEN begun THEN day || ' 01' END AS started_at, CASE WHEN ended THEN day || ' 02' END AS finished_at, CASE WHEN ended THEN bad END AS error FROM o""",
)
def run_headers(spark, sf_dir):
    """Three in four orders are known runs; of those asked for, one in two is known too and stays; some start, some end."""
    k, day = c("o_orderkey"), F.to_date("o_orderdate").cast("string")
    o = V.read(spark, sf_dir, "orders").select(k.alias("run_id"), day.alias("created_at"))
    of = lambda scope, settings, rows: rows.withColumns({"run_type": F.lit("fetch"), "scope": F.lit(scope), "total_companies": F.lit(10), "settings": settings, "targets": F.lit(None).cast("string")})
    null = F.lit(None).cast("string")
    known = of("all", F.lit('{"workers": 4}'), o.where("run_id % 4 != 0")).withColumns({"status": F.lit("interrupted"), "started_at": null, "finished_at": null, "error": null})
    made = runs.create(known, of("selected", null, o.where("run_id % 4 = 0 or run_id % 8 = 1")))
    begun = runs.start(made, o.where("run_id % 8 = 0").select("run_id", say(c("created_at"), " 01").alias("started_at")))
    ended = runs.finish(begun, o.where("run_id % 3 = 0").select("run_id", F.when(c("run_id") % 2 == 0, "no route").alias("error"), say(c("created_at"), " 02").alias("finished_at")))
    return ended.select("run_id", "status", "scope", "settings", "started_at", "finished_at", "error")


@query("cdc16_artifact_errors", "SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 3 != 0 THEN o_orderkey % 50 END AS snapshot_jobs, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 3 = 0 THEN 'disk full' WHEN o_orderkey % 5 = 0 THEN 'old' END AS artifact_error FROM orders")
def artifact_errors(spark, sf_dir):
    o = V.read(spark, sf_dir, "orders").select(c("o_orderkey").alias("run_id"))
    old = o.where("run_id % 3 != 0").select("run_id", (c("run_id") % 50).alias("snapshot_jobs"), F.when(c("run_id") % 5 == 0, "old").alias("artifact_error"))
    return runs.artifact_errors(old, o.where("run_id % 4 = 0 or run_id % 3 = 0").select("run_id", F.lit("disk full").alias("artifact_error")))


@query("cdc02_unhashed_rows", f"WITH {O.POSTINGS} SELECT ord, CASE WHEN ord % 2 = 1 THEN 'new' WHEN ord % 8 = 0 THEN 'changed' ELSE 'unchanged' END AS last_change_type, CASE WHEN ord % 2 = 1 OR ord % 8 = 0 THEN 2 ELSE 1 END AS changed_at FROM postings")
def unhashed_rows(spark, sf_dir):
    """One row in two is known; half of those have no hash, so it is that of their texts."""
    from tidewheel.functions.text import content_hash

    p = V.postings(spark, sf_dir)
    real, own = content_hash(c("title"), c("location"), c("description")), say("h", c("external_id"))
    one = F.lit(1)
    state = p.where("ord % 2 = 0").select(*KEY, "title", "location", "description", F.when(c("ord") % 4 == 2, own).alias("content_hash"), one.alias("first_seen"), one.alias("last_seen"), one.alias("changed_at"), F.lit(True).alias("active"), F.lit("new").alias("last_change_type"))
    snapshot = p.select(*KEY, F.when(c("ord") % 8 == 4, real).otherwise(own).alias("content_hash"))
    return inventory.merge(state, snapshot, F.lit(2)).select(c("external_id").cast("long").alias("ord"), "last_change_type", "changed_at")


_LEGACY = f"WITH {O.POSTINGS}"


@query("cdc14_legacy_copy", f"{_LEGACY}, o AS (SELECT external_id, ord, company_id FROM postings QUALIFY row_number() OVER (PARTITION BY company_id, ord % 7 ORDER BY ord) = 1) SELECT 'empty' AS target, company_id || '/' || (ord % 7) AS id, ord AS relevance_score FROM o UNION ALL SELECT 'filled', 'own', -1")
def legacy_copy(spark, sf_dir):
    """An older table of postings, some keys twice, copied into an empty table, and into one that holds a row and so stays."""
    legacy = V.postings(spark, sf_dir).select(say(c("company_id"), "/", (c("ord") % 7).cast("string")).alias("id"), c("ord").alias("local_score"), F.lit("x").alias("gone"))
    filled = spark.createDataFrame([("own", -1, None)], "id string, relevance_score long, note string")
    copy = lambda target: inventory.copy_legacy(target, legacy, {"local_score": "relevance_score"}, ["id"], ["local_score"])
    both = [copy(t).select(F.lit(name).alias("target"), "id", "relevance_score") for name, t in (("empty", filled.limit(0)), ("filled", filled))]
    return both[0].unionByName(both[1])


@query("flt14_browser_used", f"WITH {O.POSTINGS} SELECT 'b' || (ord % 35) AS company_id, bool_or(coalesce(starts_with(source_type, 'browser_'), false) OR ord % 7 IN (0, 1)) AS browser FROM postings GROUP BY 1")
def browser_used(spark, sf_dir):
    raw = V.pick(c("ord"), ['{"_fetch_via_browser": true}', '{"_source_response_url": "https://x.example/api"}', '{"_fetch_via_browser": false, "_source_response_url": ""}', None, "[", '{"_source_response_url": null}', "{}"])
    rows = V.postings(spark, sf_dir).select(say("b", (c("ord") % 35).cast("string")).alias("company_id"), "source_type", raw.alias("raw"))
    return health.browser_used(rows)


# --- Coverage of a provider by the official listing ----------------------------------------------------------------


def _coverage(spark, sf_dir):
    """Two in three postings stand with a provider, one in two in the official listing, each twice; a few have no official page.

    Of the even boards one lists fewer than it says, one changes meanwhile, one gives no total; board 5 was never listed.
    """
    p = V.postings(spark, sf_dir).select("ord", say("b", (c("ord") % 16).cast("string")).alias("company_id"), (c("ord") + 10000000).cast("string").alias("id"))
    link = say("https://x.example/jobs/", c("id"), "/")
    as_row = [F.when(c("ord") % 4 != 1, say("REF", c("id"))).alias("external_id"), link.alias("job_url")]
    provider = p.where("ord % 3 != 0").select("company_id", *as_row)
    listed = p.where("ord % 2 = 0")
    details = listed.where("ord % 64 != 0").select("company_id", "id", *as_row)
    n = F.count_if(c("ord") % 2 == 0)
    board = c("company_id")
    totals = p.groupBy("company_id").agg((n + F.when(board == "b2", 1).otherwise(0)).alias("total")).where("company_id != 'b5'")
    totals = totals.select("company_id", F.when(board != "b6", c("total")).alias("before"), (c("total") + F.when(board == "b4", 1).otherwise(0)).alias("after"))
    return inventory.covered(provider, listed.select("company_id", "id").unionByName(listed.select("company_id", "id")), details, totals)


_COVERED = f"""WITH {O.POSTINGS}, p AS (SELECT ord, 'b' || (ord % 16) AS company_id, CAST(ord + 10000000 AS VARCHAR) AS id FROM postings),
  v AS (SELECT company_id, CASE company_id WHEN 'b6' THEN NULL WHEN 'b2' THEN count(*) FILTER (ord % 2 = 0) + 1 ELSE count(*) FILTER (ord % 2 = 0) END AS expected, count(*) FILTER (ord % 2 = 0) AS enumerated, count(*) FILTER (ord % 64 = 0 AND ord % 3 = 0) AS missing FROM p WHERE company_id != 'b5' GROUP BY 1),
  w AS (SELECT *, CASE company_id WHEN 'b6' THEN 'total_unavailable' WHEN 'b4' THEN 'changed_during_fetch' WHEN 'b2' THEN 'incomplete_pagination' ELSE CASE WHEN missing > 0 THEN 'coverage_failed' END END AS problem FROM v)"""


@query("join11_covered", f"{_COVERED} SELECT company_id, 'https://x.example/jobs/' || id || '/' AS job_url, CASE WHEN ord % 3 != 0 THEN 'provider' ELSE 'official' END AS origin FROM p WHERE company_id IN (SELECT company_id FROM w WHERE problem IS NULL) AND (ord % 3 != 0 OR (ord % 2 = 0 AND ord % 64 != 0))")
def covered_rows(spark, sf_dir):
    return _coverage(spark, sf_dir)[0].select("company_id", "job_url", "origin")


@query("join11_verdicts", f"{_COVERED} SELECT * FROM w")
def coverage_verdicts(spark, sf_dir):
    return _coverage(spark, sf_dir)[1]


# --- Listings and payloads -----------------------------------------------------------------------------------------

_PAGERS = [
    '<a href="/p/9">Next</a><a rel="nofollow next" href="?page=2">more</a>',
    '<a href="/p/2" aria-label="Go to NEXT page">2</a><a href="/p/3">›</a>',
    '<a href="/p/1" title="next">Next</a><a href="/p/9">next  page</a>',
    '<a href="/jobs/25/">2</a><a href="/jobs/50/?x=1">more</a><a href="/job/7/">Cook</a><a href="https://other.example/5/">5</a><a href="/jobs/25/">2</a>',
    '<a href="/about">About</a>',
]


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages with the pager of a listing, in one of five forms."""
    k = c("page_id")
    url = say("https://jobs.example.com/list/", k.cast("string"))
    return V.pages(spark, sf_dir).select(k, url.alias("url"), say(F.regexp_replace("html", "</body>", ""), V.pick(k, _PAGERS), "</body></html>").alias("html"))


#: Links as pages hold them, and the boards they are.
_CAREERS = [
    ("https://job-boards.greenhouse.io/acme{k}/jobs/1", "greenhouse", "acme{k}", "job-boards.greenhouse.io", None, None),
    ("https://jobs.lever.co/acme{k}", "lever", "acme{k}", "jobs.lever.co", None, None),
    ("https://jobs.ashbyhq.com/acme{k}?x=1", "ashby", "acme{k}", "jobs.ashbyhq.com", None, None),
    ("https://careers.smartrecruiters.com/Jobs/Acme{k}/", "smartrecruiters", "Acme{k}", "careers.smartrecruiters.com", None, None),
    ("https://www.t{k}.eightfold.ai/careers", "eightfold", "t{k}", "www.t{k}.eightfold.ai", None, None),
    ("https://acme{k}.avature.net/careers", "avature", None, "acme{k}.avature.net", None, None),
    ("https://career4.successfactors.com/p?c={k}", "successfactors", None, "career4.successfactors.com", None, None),
    ("https://careers.kula.ai/acme{k}", "kula", "acme{k}", "careers.kula.ai", None, None),
    ("https://h{k}.fa.ocs.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_{k}/jobs", "oracle", None, "h{k}.fa.ocs.oraclecloud.com", "CX_{k}", "en"),
    ("https://acme.wd5.myworkdayjobs.com/en-US/Site{k}/job/x", "workday", "acme", "acme.wd5.myworkdayjobs.com", "Site{k}", None),
    ("https://jobs.lever.co/", None, None, None, None, None),
]


@query("dsc01_page_boards", "SELECT * FROM (SELECT page_id, " + ", ".join(f"replace({O.pick('page_id', [row[i] for row in _CAREERS])}, '{{k}}', CAST(page_id AS VARCHAR)) AS {name}" for i, name in enumerate(["target", "provider", "tenant", "host", "site", "locale"])) + " FROM pages) WHERE provider IS NOT NULL UNION ALL SELECT page_id, 'https://eightfold.ai/', 'eightfold', 'app', 'eightfold.ai', NULL, NULL FROM pages WHERE page_id % 3 = 0")
def page_boards(spark, sf_dir):
    """The given pages with links to boards, one twice, and one as a loose URL in a script."""
    k = c("page_id")
    link = F.replace(V.pick(k, [row[0] for row in _CAREERS]), F.lit("{k}"), k.cast("string"))
    more = say('<a href="', link, '">Careers</a><a href="', link, '">Jobs</a><a href="https://notaboard.example/lever.co">x</a><script>', F.when(k % 3 == 0, 'var u = "https:\\/\\/eightfold.ai\\/";').otherwise(""), "</script>")
    p = V.pages(spark, sf_dir).select(k, "url", say(F.regexp_replace("html", "</body>", ""), more).alias("html"))
    return discovery.boards_of(p).drop("place")


@query("dsc02_endpoints", f"WITH {O.POSTINGS}, u AS (SELECT DISTINCT company_id, 'https://api.example/' || lpad(CAST(ord % 300 AS VARCHAR), 3, '0') AS url FROM postings WHERE ord % 3 != 2), n AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY url) AS nth FROM u) SELECT company_id, string_agg(url, ' ' ORDER BY url) AS endpoints FROM n WHERE nth <= 20 GROUP BY 1")
def endpoints(spark, sf_dir):
    raw = F.when(c("ord") % 3 != 2, say('{"_source_response_url": "https://api.example/', F.lpad((c("ord") % 300).cast("string"), 3, "0"), '"}')).otherwise("{")
    return discovery.endpoints(V.postings(spark, sf_dir).select("company_id", raw.alias("raw")), 20).select("company_id", F.array_join("endpoints", " ").alias("endpoints"))


@query("qry07_run_detail", f"WITH {O.BOARDS}, {_RESULTS}, m AS (SELECT f.*, company_name, CASE WHEN rank % 4 != 0 THEN rank END AS rank FROM found f JOIN boards USING (company_id) WHERE run_id = (SELECT max(run_id) FROM found)) SELECT company_id, row_number() OVER (ORDER BY coalesce(rank, 999999), company_name, company_id) AS place, CASE WHEN jobs_found % 2 = 0 THEN jobs_found END AS jobs FROM m")
def run_detail(spark, sf_dir):
    """The newest run; every second payload isn't an object."""
    named = V.boards(spark, sf_dir).select("company_id", "company_name", F.when(c("rank") % 4 != 0, c("rank")).alias("rank"))
    r = results(spark, sf_dir).withColumn("nth", F.row_number().over(Window.partitionBy("run_id", "company_id").orderBy(F.desc("created_at")))).where("nth = 1").join(named, "company_id")
    r = r.withColumn("payload", F.when(c("jobs_found") % 2 == 0, say('{"jobs": ', c("jobs_found").cast("string"), "}")).otherwise("[1]"))
    newest = search.run_list(r.select("run_id", c("run_id").alias("created_at")).distinct(), limit=1).first()
    return search.run_detail(r, newest.run_id if newest else None).select("company_id", "place", F.try_variant_get("payload", "$.jobs", "bigint").alias("jobs"))


_AT = "'https://jobs.example.com"


@query("srt09_next_page", f"SELECT page_id, CASE page_id % 5 WHEN 0 THEN {_AT}/list/' || page_id || '?page=2' WHEN 1 THEN {_AT}/p/3' ELSE {_AT}/p/1' END AS url FROM pages WHERE page_id % 5 < 3")
def next_page(spark, sf_dir):
    return pages.next_pages(pages.links(listings(spark, sf_dir)))


@query("srt09_labelled_next", f"SELECT page_id, CASE page_id % 5 WHEN 0 THEN {_AT}/list/' || page_id || '?page=2' WHEN 1 THEN {_AT}/p/2' ELSE {_AT}/p/1' END AS url FROM pages WHERE page_id % 5 < 3")
def labelled_next(spark, sf_dir):
    return pages.next_pages(pages.links(listings(spark, sf_dir)), "labelled")


@query("srt09_numbered_pages", f"SELECT page_id, {_AT}' || unnest(CASE page_id % 5 WHEN 0 THEN ['/p/9'] WHEN 1 THEN ['/p/2', '/p/3'] WHEN 2 THEN ['/p/1', '/p/9'] WHEN 3 THEN ['/jobs/25/', '/jobs/50/?x=1'] END) AS url FROM pages WHERE page_id % 5 < 4")
def numbered_pages(spark, sf_dir):
    p = listings(spark, sf_dir)
    return pages.numbered_pages(p, pages.links(p)).select("page_id", "url")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings as payloads of one position each, its text and URL in one of several fields."""
    k, n = c("ord"), c("external_id")
    field = V.pick(k, landing.PCS_TEXTS)
    url = F.when(k % 3 == 0, say(', "publicUrl": "https://own.example/p/', n, '"')).when(k % 3 == 1, say(', "publicUrl": "own", "positionUrl": "/careers/at/', n, '"')).otherwise("")
    place = F.coalesce(c("location"), F.lit(""))
    body = say('{"positions": [{"id": ', n, ', "name": "', c("title"), '", "locations": ["', place, '", " Goa ", "Goa"], "standardizedLocations": ["', F.when(k % 4 == 0, "Goa, GA, IN").otherwise("London, GB"), '"], "', field, '": "<p>Own it &amp; run ', n, '</p>", "postedTs": ', F.when(k % 5 == 0, "0").otherwise((k + 1700000000).cast("string")), url, "}]}")
    return V.postings(spark, sf_dir).select("company_id", body.alias("body"))


@query(
    "src11_positions",
    f"""WITH {O.POSTINGS} SELECT external_id, title, CASE WHEN location IS NULL THEN 'Goa' ELSE location || ' | Goa' END AS location, 'Own it & run ' || ord AS description,
    CASE ord % 3 WHEN 0 THEN 'https://own.example/p/' || ord WHEN 1 THEN 'https://t.example/careers/at/' || ord || '?domain=a.com&hl=en' ELSE 'https://t.example/careers/job/' || ord || '?domain=a.com&hl=en' END AS job_url,
    CASE WHEN ord % 5 != 0 THEN strftime(make_timestamp((ord + 1700000000) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') END AS posted_at FROM postings WHERE ord % 4 = 0 OR location ILIKE '%india%'""",
)
def pcs(spark, sf_dir):
    return landing.pcs_positions(positions(spark, sf_dir), "https://t.example/x", "a.com", india_only=True).drop("company_id", "source_type", "ord")


def _skills_sql() -> str:
    def one(skill) -> str:
        name, aliases, weight = skill
        kind = "demonstrated" if name in P.DEMONSTRATED else "resume_skill"
        made = lambda context, share: f"{{'name': {O.text(name)}, 'points': {round(weight * share, 2)}::DOUBLE, 'max': {weight}::DOUBLE, 'context': '{context}', 'evidence': '{kind}'}}"
        return f"CASE WHEN {O.any_of('nreq', aliases)} THEN {made('required', 1.0)} WHEN {O.any_of('npref', aliases)} THEN {made('preferred', 0.55)} WHEN {O.any_of('nfull', aliases)} THEN {made('general', 0.85)} END"

    return f"WITH {O.POSTINGS}, {O.scoring()}, m AS (SELECT external_id, unnest([{', '.join(one(s) for s in P.PRIMARY_SKILLS + P.SUPPORTING_SKILLS)}]) AS s FROM texts) SELECT external_id, s.name AS name, s.points AS points, s.max AS \"max\", s.context AS context, s.evidence AS evidence FROM m WHERE s IS NOT NULL"


@query("scl35_matched_skills", _skills_sql())
def matched_skills(spark, sf_dir):
    rows = relevance.score(V.postings(spark, sf_dir)).select("external_id", F.explode(F.concat("matched_primary", "matched_supporting")).alias("s"))
    return rows.select("external_id", "s.*")
