"""The registered queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.functions import predicates as R
from tidewheel.functions import profile as P
from tidewheel.functions import text as T
from tidewheel.operators import extract, gate, health, inventory, location, matching, neardup, relevance, runs
from tidewheel.operators.stored import files_key, stored_once
from tidewheel.plans import oracle as O
from tidewheel.plans import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
KEY = ["company_id", "external_id"]


def query(name: str, sql: str | None = None):
    def keep(f):
        if name in QUERIES:
            raise ValueError(f"a query {name} is there already")
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def c(name: str):
    return F.col(name)


# --- Text rules over postings ------------------------------------------------------------------------------------


@query(
    "scl01_stable_id",
    f"WITH {O.POSTINGS} SELECT ord, CASE WHEN ord % 3 != 0 THEN external_id ELSE sha256(concat_ws('|', coalesce(company_id, ''), coalesce(title, ''), coalesce(location, ''), coalesce(job_url, ''))) END AS stable_id FROM postings",
)
def stable_id(spark, sf_dir):
    p = V.postings(spark, sf_dir)
    return p.select("ord", T.stable_id(F.when(c("ord") % 3 != 0, c("external_id")), c("company_id"), c("title"), c("location"), c("job_url")).alias("stable_id"))


@query("scl02_clean_text", f"WITH {O.POSTINGS} SELECT ord, md5(nullif(trim(regexp_replace(description, '\\s+', ' ', 'g')), '')) AS clean FROM postings")
def clean_text(spark, sf_dir):
    return V.postings(spark, sf_dir).select("ord", F.md5(T.clean_text(c("description"))).alias("clean"))


@query("scl04_normalize_text", f"WITH {O.POSTINGS} SELECT ord, {O.norm('title')} AS title, md5({O.norm('description')}) AS description FROM postings")
def normal_text(spark, sf_dir):
    return V.postings(spark, sf_dir).select("ord", T.normalize_text(c("title")).alias("title"), F.md5(T.normalize_text(c("description"))).alias("description"))


@query("scl05_content_hash", f"WITH {O.POSTINGS} SELECT ord, {O.content_hash()} AS content_hash FROM postings")
def content_hash(spark, sf_dir):
    return V.postings(spark, sf_dir).select("ord", T.content_hash(c("title"), c("location"), c("description")).alias("content_hash"))


@query("scl06_analysis_hash", f"WITH {O.POSTINGS} SELECT ord, sha256('{P.RULESET}:' || {O.content_hash()}) AS analysis_hash FROM postings")
def analysis_hash(spark, sf_dir):
    return V.postings(spark, sf_dir).select("ord", T.analysis_hash(T.content_hash(c("title"), c("location"), c("description"))).alias("analysis_hash"))


@query("scl07_coarse_location", f"WITH {O.POSTINGS} SELECT ord, {O.coarse_location()} AS place, {O.plainly_foreign()} AS abroad FROM postings")
def coarse_location(spark, sf_dir):
    return V.postings(spark, sf_dir).select("ord", T.coarse_location(c("location")).alias("place"), T.plainly_foreign(T.normalize_text(c("location"))).alias("abroad"))


@query("scl08_dedup_title", f"WITH {O.POSTINGS} SELECT title, {O.dedup_title()} AS dedup_title, count(*) AS n FROM postings GROUP BY ALL")
def dedup_title(spark, sf_dir):
    return V.postings(spark, sf_dir).groupBy("title", T.dedup_title(c("title")).alias("dedup_title")).agg(F.count("*").alias("n"))


@query("scl09_near_block", f"WITH {O.POSTINGS} SELECT concat_ws('|', company_id, {O.dedup_title()}, lower({O.coarse_location()})) AS block, count(*) AS n FROM postings GROUP BY 1")
def near_block(spark, sf_dir):
    return V.postings(spark, sf_dir).groupBy(T.near_block(c("company_id"), c("title"), c("location")).alias("block")).agg(F.count("*").alias("n"))


@query("scl23_signals", f"WITH {O.POSTINGS}, t AS (SELECT ord, {O.norm('description')} AS x FROM postings) SELECT ord, {', '.join(f'{O.any_of('x', words)} AS {k}' for k, words in P.SIGNALS.items())} FROM t")
def signals(spark, sf_dir):
    t = V.postings(spark, sf_dir).select("ord", T.normalize_text(c("description")).alias("x"))
    return t.select("ord", *(T.has_any(c("x"), words).alias(k) for k, words in P.SIGNALS.items()))


@query("scl15_numeric_id", "SELECT page_id, nullif(regexp_extract(url, '(\\d{2,})', 1), '') AS numeric_id FROM pages")
def numeric_id(spark, sf_dir):
    return V.pages(spark, sf_dir).select("page_id", T.numeric_id(c("url"), 2).alias("numeric_id"))


@query("scl14_set_parameter", "SELECT page_id, CASE WHEN url LIKE '%?page=%' THEN regexp_replace(regexp_replace(url, '\\?page=\\d+&', '?'), '(#.*)?$', '&page=9\\1') WHEN contains(url, '?') THEN regexp_replace(url, '(#.*)?$', '&page=9\\1') ELSE regexp_replace(url, '(#.*)?$', '?page=9\\1') END AS url FROM pages")
def set_parameter(spark, sf_dir):
    return V.pages(spark, sf_dir).select("page_id", T.set_query_parameter(c("url"), "page", F.lit(9)).alias("url"))


@query("scl33_slug", "SELECT s_suppkey, regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM supplier")
def slug(spark, sf_dir):
    return V.read(spark, sf_dir, "supplier").select("s_suppkey", T.slug(c("s_name")).alias("slug"))


_ERRORS = " ".join(f"WHEN {O.has('low', words)} THEN {O.text(name)}" for words, name in T._ERRORS)


@query(
    "scl29_error_category",
    f"SELECT category, count(*) AS n FROM (SELECT CASE {_ERRORS} WHEN contains(low, 'playwright') AND (contains(low, 'executable') OR contains(low, 'browser')) THEN 'browser_runtime_missing' ELSE 'fetch_or_parse_error' END AS category "
    "FROM (SELECT lower(CASE conv_id % 6 WHEN 0 THEN 'HTTP 403 ' WHEN 1 THEN 'Timeout: ' WHEN 2 THEN 'HTTP 429 ' WHEN 3 THEN 'bot challenge ' WHEN 4 THEN 'failed to resolve ' ELSE '' END || text) AS low FROM conversations)) GROUP BY 1",
)
def error_category(spark, sf_dir):
    prefix = V.pick(c("conv_id"), ["HTTP 403 ", "Timeout: ", "HTTP 429 ", "bot challenge ", "failed to resolve ", ""])
    return V.read(spark, sf_dir, "conversations").groupBy(T.error_category(F.concat(prefix, "text")).alias("category")).agg(F.count("*").alias("n"))


@query(
    "scl30_title_evidence",
    f"""WITH {O.PROBES}, t AS (SELECT conv_id, turn, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t, regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g') AS b FROM probes),
    k AS (SELECT *, list_filter(string_split(t, ' '), lambda x: len(x) >= 4 AND x NOT IN ('senior', 'junior', 'staff', 'lead')) AS toks FROM t)
    SELECT conv_id, turn, t != '' AND (contains(b, t) OR (len(toks) > 0 AND len(list_filter(toks, lambda x: contains(b, x))) >= least(2, len(toks)))) AS found FROM k""",
)
def title_evidence(spark, sf_dir):
    return V.probes(spark, sf_dir).select("conv_id", "turn", T.title_evidence(c("title"), c("body")).alias("found"))


@query("scl17_epoch", "SELECT event_id, CASE WHEN s > 0 THEN strftime(make_timestamp(CAST(s * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S+00:00') END AS posted FROM (SELECT event_id, event_id % 90000 * 86400 + event_id % 86400 AS s FROM events)")
def epoch(spark, sf_dir):
    """Every event: the id is folded into 90000 days and the seconds of a day, which the year's four digits hold."""
    return V.read(spark, sf_dir, "events").select("event_id", T.epoch_iso((c("event_id") % 90000 * 86400 + c("event_id") % 86400).cast("string")).alias("posted"))


# --- Predicates --------------------------------------------------------------------------------------------------

_ROLE = f"regexp_matches(coalesce(title, ''), '(?i)\\b(?:{'|'.join(P.ROLE_NOUNS)})\\b')"
_TAILS = "|".join(P.LISTING_TAILS)


def _nav(t: str) -> str:
    low = f"regexp_replace(regexp_replace({O.strip(f'lower(coalesce({t}, {O.text('')}))')}, '\\s+', ' ', 'g'), '^[ :–—-]+|[ :–—-]+$', '', 'g')"
    starts = " OR ".join(f"starts_with({low}, {O.text(s)})" for s in P.NAVIGATION_STARTS)
    role = _ROLE.replace("title", t)
    return f"({low} = '' OR {low} IN ({', '.join(O.text(x) for x in [*P.ACTION_ONLY, *P.NAVIGATION])}) OR {starts} OR (NOT {role} AND regexp_matches(coalesce({t}, ''), {O.text(P.NAVIGATION_PATTERN)})))"


def _strong(url: str) -> str:
    """By segments, not by one pattern."""
    path = f"lower(regexp_replace(regexp_replace(regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/$', ''))"
    segs = f"list_filter(string_split({path}, '/'), lambda x: x != '')"
    pairs = f"list_transform(range(1, greatest(len({segs}), 1)), lambda i: list_contains({O.array(P.DETAIL_MARKERS)}, ({segs})[i]) AND NOT list_contains({O.array(P.LISTING_TAILS)}, ({segs})[i + 1]))"
    keys = f"(?i)(?:^|&)(?:{'|'.join(P.JOB_QUERY_KEYS)})(?:=|&|$)"
    return f"coalesce(regexp_matches({url}, '^https?://[^/?#]+') AND (list_contains({pairs}, true) OR regexp_matches({path}, '/careers?/details?/[^/]+$') OR regexp_matches({path}, '/careerhub/explore/jobs/[^/]+$') OR regexp_matches(regexp_extract({url}, '\\?([^#]*)', 1), '{keys}') OR regexp_matches(regexp_extract({url}, '#(.*)', 1), '{keys}')), false)"


def _plausible() -> str:
    bare = f"regexp_replace(lower({O.strip('title')}), '^[ :–—-]+|[ :–—-]+$', '', 'g')"
    return f"""CASE WHEN coalesce({O.strip("title")}, '') = '' THEN false WHEN lower(source_type) IN ({", ".join(O.text(x) for x in P.AUTHORITATIVE)}) THEN true
      WHEN {bare} IN ({", ".join(O.text(x) for x in P.ACTION_ONLY)}) THEN false WHEN {_strong("job_url")} THEN true WHEN {_nav("title")} THEN false
      WHEN regexp_matches(lower(source_type), '(^|_)(generic|browser|recovery_browser|official)_?html$|_html$') THEN {_ROLE} ELSE true END"""


@query("flt01_valid_url", f"WITH {O.POSTINGS} SELECT ord, coalesce(regexp_matches(job_url, '^https?://[^/?#]+'), false) AS ok FROM postings")
def valid_url(spark, sf_dir):
    return V.postings(spark, sf_dir).select("ord", R.valid_url(c("job_url")).alias("ok"))


@query("flt02_role_title", f"WITH {O.POSTINGS} SELECT title, {_ROLE} AS role, count(*) AS n FROM postings GROUP BY ALL")
def role_title(spark, sf_dir):
    return V.postings(spark, sf_dir).groupBy("title", R.role_like(c("title")).alias("role")).agg(F.count("*").alias("n"))


@query("flt03_detail_url", f"WITH {O.POSTINGS} SELECT ord, {_strong('job_url')} AS strong FROM postings UNION ALL SELECT -1 - page_id, {_strong('url')} FROM pages")
def detail_url(spark, sf_dir):
    p, q = V.postings(spark, sf_dir), V.pages(spark, sf_dir)
    return p.select("ord", F.coalesce(R.strong_detail_url(c("job_url")), F.lit(False)).alias("strong")).unionByName(q.select((-1 - c("page_id")).alias("ord"), F.coalesce(R.strong_detail_url(c("url")), F.lit(False)).alias("strong")))


@query("flt04_navigation", f"WITH {O.POSTINGS} SELECT title, {_nav('title')} AS nav, count(*) AS n FROM postings GROUP BY ALL")
def navigation(spark, sf_dir):
    return V.postings(spark, sf_dir).groupBy("title", R.navigation_like(c("title")).alias("nav")).agg(F.count("*").alias("n"))


@query("flt05_plausible", f"WITH {O.POSTINGS} SELECT ord, {_plausible()} AS ok FROM postings")
def plausible(spark, sf_dir):
    return V.postings(spark, sf_dir).select("ord", R.plausible(c("title"), c("source_type"), c("job_url")).alias("ok"))


@query("flt10_page_markers", f"SELECT page_id, regexp_matches(substr(coalesce(html, ''), 1, 15000), '(?i){R.CHALLENGE}') AS challenged, regexp_matches(substr(coalesce(html, ''), 1, 50000), '(?i){R.EMPTY_BOARD}') AS empty_board, contains(lower(url), 'successfactors') OR contains(lower(substr(html, 1, 250000)), 'successfactors') OR contains(lower(substr(html, 1, 250000)), 'jobs2web') AS sf, {O.has('lower(regexp_extract(url, \'^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)\', 1))', R.ATS_HOSTS)} AS ats FROM pages")
def page_markers(spark, sf_dir):
    return V.pages(spark, sf_dir).select("page_id", R.challenged(c("html")).alias("challenged"), R.empty_board(c("html")).alias("empty_board"), R.successfactors_page(c("html"), c("url")).alias("sf"), R.ats_host(c("url")).alias("ats"))


@query("flt06_title_exclusion", f"WITH {O.POSTINGS} SELECT title, CASE {' '.join(f'WHEN contains({O.norm("title")}, {O.text(p)}) THEN {O.text("excluded_title:" + p)}' for p in P.TITLE_EXCLUSIONS)} END AS reason, count(*) AS n FROM postings GROUP BY ALL")
def title_exclusion(spark, sf_dir):
    return V.postings(spark, sf_dir).groupBy("title", R.title_excluded(T.normalize_text(c("title"))).alias("reason")).agg(F.count("*").alias("n"))


# --- Location and relevance --------------------------------------------------------------------------------------


@query("loc01_classify", f"WITH {O.POSTINGS}, {O.located()} SELECT external_id, status, normalized, evidence FROM located")
def classify(spark, sf_dir):
    p = location.classify(V.postings(spark, sf_dir).select("external_id", "location", "description"), prefix="")
    return p.select("external_id", "status", "normalized", "evidence")


_SCORE = ["role_family", "role_score", "experience_score", "primary_skill_score", "supporting_score", "relevance_score", "relevance_status", "filter_reason", "normalized_location"]


@query("rel01_score", f"WITH {O.POSTINGS}, {O.scoring()} SELECT external_id, low AS min_experience, high AS max_experience, {', '.join(_SCORE)} FROM scored")
def scores(spark, sf_dir):
    return relevance.score(V.postings(spark, sf_dir)).select("external_id", "min_experience", "max_experience", *_SCORE)


_POLICY = f"""WITH {O.POSTINGS}, {O.scoring()}, {O.located()}, analysed AS (
  SELECT s.company_id, s.external_id, s.company_name, s.title, s.active, s.role_family, s.relevance_score, s.last_change_type, s.description, s.location, s.posted_at, s.first_seen_day, l.normalized AS normalized_location, l.status AS location_status,
    s.hard_filtered OR l.status != 'india' AS hard_filtered, s.is_relevant AND l.status = 'india' AS is_relevant,
    CASE WHEN l.status != 'india' THEN 'filtered' ELSE s.relevance_status END AS relevance_status,
    CASE l.status WHEN 'india' THEN s.filter_reason WHEN 'foreign' THEN 'location_outside_target' ELSE 'location_unverified_india' END AS filter_reason
  FROM scored s JOIN located l USING (external_id))"""


def _analysed(spark, sf_dir):
    return relevance.apply_location_policy(relevance.score(V.postings(spark, sf_dir)))


def _analyses(spark, sf_dir):
    """The stored analysis, which searches and counts read; made once for the postings' files and the rules."""
    keep = ["ord", "company_id", "external_id", "company_name", "title", "active", "last_change_type", "posted_at", "first_seen_day", "location_status", *relevance.SCORED]
    return stored_once(lambda: _analysed(spark, sf_dir).select(*keep), "analysis", P.RULESET + files_key(spark, f"{sf_dir}/documents.parquet"), spark)


_POLICY_COLUMNS = ["external_id", "normalized_location", "hard_filtered", "is_relevant", "relevance_status", "filter_reason", "relevance_score"]


@query("rel02_location_policy", f"{_POLICY} SELECT {', '.join(_POLICY_COLUMNS)} FROM analysed")
def location_policy(spark, sf_dir):
    return _analysed(spark, sf_dir).select(*_POLICY_COLUMNS)


@query("flagship_relevance_mix", f"{_POLICY} SELECT relevance_status, role_family, count(*) AS n, max(relevance_score) AS best FROM analysed GROUP BY ALL")
def relevance_mix(spark, sf_dir):
    return _analysed(spark, sf_dir).groupBy("relevance_status", "role_family").agg(F.count("*").alias("n"), F.max("relevance_score").alias("best"))


def _previous(spark, sf_dir):
    """An earlier analysis: half of the postings as they are now, a quarter with an older text."""
    p = V.postings(spark, sf_dir).where("ord % 4 != 3")
    hashed = T.analysis_hash(T.content_hash(c("title"), c("location"), F.when(c("ord") % 4 == 2, F.lit("older")).otherwise(c("description"))))
    return _analyses(spark, sf_dir).where("ord % 4 != 3").join(p.select(*KEY, hashed.alias("source_hash")), KEY).withColumn("change_type", F.lit("baseline"))


@query(
    "rel03_incremental",
    f"{_POLICY} SELECT company_id, external_id, CAST(external_id AS BIGINT) % 4 IN (2, 3) AS analyzed, CASE WHEN last_change_type IS NOT NULL THEN last_change_type WHEN CAST(external_id AS BIGINT) % 4 = 3 THEN 'baseline' WHEN CAST(external_id AS BIGINT) % 4 = 2 THEN 'changed' ELSE 'unchanged' END AS change_type, relevance_score, relevance_status FROM analysed",
)
def incremental(spark, sf_dir):
    out = relevance.analyze(V.postings(spark, sf_dir), _previous(spark, sf_dir))
    return out.select(*KEY, "analyzed", "change_type", "relevance_score", "relevance_status")


@query(
    "agg05_relevance_stats",
    f"""{_POLICY}, s AS (SELECT count(*) FILTER (active) AS active_jobs, count(*) FILTER (active AND is_relevant) AS relevant_jobs, count(*) FILTER (active AND last_change_type IN ('new', 'changed')) AS new_changed, count(*) FILTER (active AND is_relevant AND last_change_type IN ('new', 'changed')) AS relevant_new_changed FROM analysed)
    SELECT * FROM s""",
)
def relevance_stats(spark, sf_dir):
    recent = c("last_change_type").isin("new", "changed")
    return _analyses(spark, sf_dir).agg(F.count_if("active").alias("active_jobs"), F.count_if(c("active") & c("is_relevant")).alias("relevant_jobs"), F.count_if(c("active") & recent).alias("new_changed"), F.count_if(c("active") & c("is_relevant") & recent).alias("relevant_new_changed"))


@query("agg05_filter_reasons", f"{_POLICY} SELECT coalesce(filter_reason, 'unknown') AS reason, count(*) AS n FROM analysed WHERE active AND relevance_status = 'filtered' GROUP BY 1")
def filter_reasons(spark, sf_dir):
    return _analyses(spark, sf_dir).where("active and relevance_status = 'filtered'").groupBy(F.coalesce("filter_reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"))


@query("agg06_india_stats", f"{_POLICY} SELECT relevance_status, count(*) AS n, count(*) FILTER (is_relevant) AS relevant FROM analysed WHERE active AND normalized_location ILIKE '%India%' GROUP BY 1")
def india_stats(spark, sf_dir):
    return _analyses(spark, sf_dir).where(c("active") & R.mentions_india(c("normalized_location"))).groupBy("relevance_status").agg(F.count("*").alias("n"), F.count_if("is_relevant").alias("relevant"))


@query("qry02_search_relevance", f"{_POLICY} SELECT external_id, title, relevance_score FROM analysed WHERE relevance_score >= 30 AND role_family LIKE 'java%' AND title ILIKE '%engineer%' ORDER BY is_relevant DESC, relevance_score DESC, company_name, title, external_id LIMIT 50")
def search_relevance(spark, sf_dir):
    a = _analyses(spark, sf_dir).where((c("relevance_score") >= 30) & c("role_family").startswith("java") & R.text_search("engineer", c("title")))
    return a.orderBy(F.desc("is_relevant"), F.desc("relevance_score"), "company_name", "title", "external_id").limit(50).select("external_id", "title", "relevance_score")


# --- Gate and dedupes --------------------------------------------------------------------------------------------


@query("ded01_extraction", f"WITH {O.POSTINGS} SELECT ord FROM postings QUALIFY row_number() OVER (PARTITION BY coalesce(job_url, ''), lower(title), lower(coalesce(location, '')) ORDER BY ord) = 1")
def dedupe_extraction(spark, sf_dir):
    return gate.dedupe_extracted(V.postings(spark, sf_dir)).select("ord")


_QUALITY_KEY = "CASE WHEN regexp_matches(coalesce(job_url, ''), '^https?://[^/?#]+') THEN 'u' || job_url WHEN coalesce(external_id, '') != '' THEN 'i' || external_id WHEN trim(coalesce(title, '')) != '' AND trim(coalesce(location, '')) != '' THEN 'f' || lower(title) || chr(1) || lower(location) ELSE 'f' END"


@query("ded02_quality", f"WITH {O.POSTINGS} SELECT ord FROM postings QUALIFY row_number() OVER (PARTITION BY company_id, {_QUALITY_KEY} ORDER BY ord) = 1")
def dedupe_quality(spark, sf_dir):
    return gate.dedupe_quality(V.postings(spark, sf_dir)).select("ord")


@query(
    "gate01_quality_gate",
    f"""WITH {O.POSTINGS}, good AS (SELECT *, coalesce(regexp_matches(job_url, '^https?://[^/?#]+'), false) AS usable FROM postings WHERE {_plausible()}),
    kept AS (SELECT * FROM good g WHERE usable OR NOT EXISTS (SELECT 1 FROM good u WHERE u.usable AND u.company_id = g.company_id AND (u.external_id = g.external_id OR (lower(u.title) = lower(g.title) AND lower(u.location) = lower(g.location)))))
    SELECT ord, job_url FROM kept QUALIFY row_number() OVER (PARTITION BY company_id, {_QUALITY_KEY} ORDER BY ord) = 1""",
)
def quality_gate(spark, sf_dir):
    return gate.gate(V.postings(spark, sf_dir)).select("ord", "job_url")


@query(
    "agg13_board_quality",
    f"""WITH {O.POSTINGS} SELECT company_id, count(*) AS n, count(*) FILTER (regexp_matches(coalesce(job_url, ''), '^https?://[^/?#]+')) AS urls_valid, count(DISTINCT external_id) AS unique_jobs, count(*) FILTER (coalesce(location, '') != '') AS locations,
    round(count(*) FILTER (regexp_matches(coalesce(job_url, ''), '^https?://[^/?#]+')) / count(*), 4) AS quality_ratio, string_agg(DISTINCT source_type, ',' ORDER BY source_type) AS source_types FROM postings GROUP BY 1""",
)
def board_quality(spark, sf_dir):
    return gate.board_quality(V.postings(spark, sf_dir)).select("company_id", "n", "urls_valid", "unique_jobs", "locations", "quality_ratio", "source_types")


@query(
    "win08_even_sample",
    f"WITH {O.POSTINGS}, r AS (SELECT company_id, ord, row_number() OVER (PARTITION BY company_id ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY company_id) AS n FROM postings) SELECT company_id, ord FROM r WHERE n <= 5 OR list_contains(list_transform(range(5), lambda k: CAST(round_even(k * (n - 1) / 4, 0) AS BIGINT)), i)",
)
def even_sample(spark, sf_dir):
    return gate.even_sample(V.postings(spark, sf_dir), 5).select("company_id", "ord")


# --- Inventory aggregates, windows, pages ------------------------------------------------------------------------


@query("agg01_counts", f"WITH {O.POSTINGS} SELECT company_name, count(*) AS n FROM postings WHERE active GROUP BY ROLLUP (company_name)")
def counts(spark, sf_dir):
    return V.postings(spark, sf_dir).where("active").rollup("company_name").agg(F.count("*").alias("n"))


@query("agg02_company_counts", f"WITH {O.POSTINGS} SELECT company_id, count(*) AS total, count(*) FILTER (active) AS active FROM postings GROUP BY 1")
def company_counts(spark, sf_dir):
    return V.postings(spark, sf_dir).groupBy("company_id").agg(F.count("*").alias("total"), F.count_if("active").alias("active"))


@query("agg03_totals", f"WITH {O.POSTINGS} SELECT count(*) AS total, count(*) FILTER (active) AS active FROM postings")
def totals(spark, sf_dir):
    return V.postings(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if("active").alias("active"))


@query("agg12_company_names", f"WITH {O.POSTINGS} SELECT company_id, max(company_name) AS company_name FROM postings GROUP BY 1")
def company_names(spark, sf_dir):
    return V.postings(spark, sf_dir).groupBy("company_id").agg(F.max("company_name").alias("company_name"))


@query("agg14_source_types", f"WITH {O.POSTINGS} SELECT company_id, array_to_string((list_sort(list(DISTINCT source_type)))[1:50], ',') AS source_types FROM postings GROUP BY 1")
def source_types(spark, sf_dir):
    return V.postings(spark, sf_dir).groupBy("company_id").agg(F.array_join(F.slice(F.sort_array(F.collect_set("source_type")), 1, 50), ",").alias("source_types"))


@query("agg16_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("documents", "events", "pages", "labels", "conversations")))
def table_counts(spark, sf_dir):
    out = None
    for t in ("documents", "events", "pages", "labels", "conversations"):
        one = V.read(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("srt01_search_page", f"WITH {O.POSTINGS} SELECT external_id, title, posted_at FROM postings WHERE (title ILIKE '%engineer%' OR description ILIKE '%engineer%' OR company_name ILIKE '%engineer%' OR location ILIKE '%engineer%') AND location ILIKE '%india%' AND active AND CAST(posted_at AS DATE) >= DATE '2026-03-01' ORDER BY active DESC, coalesce(posted_at, '') DESC, first_seen_day DESC, company_name, title, external_id LIMIT 50 OFFSET 50")
def search_page(spark, sf_dir):
    p = V.postings(spark, sf_dir)
    p = p.where(R.text_search("engineer", c("title"), c("description"), c("company_name"), c("location")) & R.text_search("india", c("location")) & c("active") & (F.try_to_date("posted_at") >= F.to_date(F.lit("2026-03-01"))))
    return p.orderBy(F.desc("active"), F.desc(T.blank(c("posted_at"))), F.desc("first_seen_day"), "company_name", "title", "external_id").offset(50).limit(50).select("external_id", "title", "posted_at")


@query("srt04_company_top", f"WITH {O.POSTINGS} SELECT company_id, external_id FROM postings WHERE active QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY posted_at DESC, external_id) <= 5")
def company_top(spark, sf_dir):
    w = Window.partitionBy("company_id").orderBy(F.desc("posted_at"), "external_id")
    return V.postings(spark, sf_dir).where("active").withColumn("place", F.row_number().over(w)).where("place <= 5").select("company_id", "external_id")


@query("srt05_top_locations", f"WITH {O.POSTINGS} SELECT location, count(*) AS n FROM postings WHERE trim(coalesce(location, '')) != '' GROUP BY 1 ORDER BY n DESC, location LIMIT 250")
def top_locations(spark, sf_dir):
    return V.postings(spark, sf_dir).where("trim(coalesce(location, '')) != ''").groupBy("location").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "location").limit(250)


@query("src01_companies", f"WITH {O.BOARDS} SELECT * FROM boards WHERE enabled")
def companies(spark, sf_dir):
    return V.boards(spark, sf_dir).where("enabled")


@query("src02_inventory", f"WITH {O.POSTINGS} SELECT company_id, external_id, title, active FROM postings WHERE active")
def active_inventory(spark, sf_dir):
    return V.postings(spark, sf_dir).where("active").select("company_id", "external_id", "title", "active").orderBy("company_id", "title", "external_id")


@query("src03_mapped_fields", "SELECT event_id, json_extract_string(props, '$.k') AS external_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def mapped_fields(spark, sf_dir):
    e = V.read(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return e.select("event_id", F.try_variant_get("v", "$.k", "string").alias("external_id"), F.try_variant_get("v", "$.k", "bigint").alias("k"))


@query("win09_shards", f"WITH {O.BOARDS} SELECT company_id, (row_number() OVER (ORDER BY rank, company_id) - 1) % 4 AS shard FROM boards")
def shards(spark, sf_dir):
    return inventory.dealt(V.boards(spark, sf_dir), ["rank", "company_id"], 4).select("company_id", "shard")


@query("win11_next_rank", f"WITH {O.BOARDS} SELECT max(rank) + 1 AS next_rank FROM boards")
def next_rank(spark, sf_dir):
    return V.boards(spark, sf_dir).agg((F.max("rank") + 1).alias("next_rank"))


# --- Change capture ----------------------------------------------------------------------------------------------

_EVENTS = f"""WITH {O.SNAPSHOTS}, runs AS (SELECT DISTINCT company_id, run FROM snapshots), o AS (SELECT *, lag(run) OVER (PARTITION BY company_id ORDER BY run) AS prev, lead(run) OVER (PARTITION BY company_id ORDER BY run) AS nxt FROM runs),
events_ AS (
  SELECT s.run, s.company_id, s.external_id, s.content, CASE WHEN b.content IS NULL THEN 'new' WHEN b.content != s.content THEN 'changed' ELSE 'unchanged' END AS event, true AS observed
  FROM snapshots s JOIN o USING (company_id, run) LEFT JOIN snapshots b ON b.company_id = s.company_id AND b.external_id = s.external_id AND b.run = o.prev
  UNION ALL SELECT o.nxt, s.company_id, s.external_id, s.content, 'closed', false FROM snapshots s JOIN o USING (company_id, run)
  WHERE o.nxt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM snapshots a WHERE a.company_id = s.company_id AND a.external_id = s.external_id AND a.run = o.nxt))"""


@query("evt01_run_events", f"{_EVENTS} SELECT run, company_id, external_id, content, event, observed FROM events_")
def run_events(spark, sf_dir):
    return inventory.replay(V.snapshots(spark, sf_dir))


@query("agg07_run_summary", f"{_EVENTS} SELECT run, count(*) FILTER (observed) AS snapshot, count(*) FILTER (event = 'new') AS new, count(*) FILTER (event = 'changed') AS changed, count(*) FILTER (event = 'unchanged') AS unchanged, count(*) FILTER (event = 'closed') AS closed FROM events_ GROUP BY 1")
def run_summary(spark, sf_dir):
    e = inventory.replay(V.snapshots(spark, sf_dir))
    return e.groupBy("run").agg(F.count_if("observed").alias("snapshot"), *(F.count_if(c("event") == k).alias(k) for k in ("new", "changed", "unchanged", "closed")))


@query("dlv01_delivery", f"{_EVENTS} SELECT run, company_id, external_id, event FROM events_ WHERE content IN ('click', 'purchase', 'view') AND CASE WHEN run = (SELECT min(run) FROM events_) THEN observed ELSE event IN ('new', 'changed') END")
def delivery(spark, sf_dir):
    e = inventory.replay(V.snapshots(spark, sf_dir))
    modes = inventory.delivery_modes(e.select("run").distinct().withColumn("created_at", c("run")))
    return inventory.delivery(e, modes, c("content").isin("click", "purchase", "view")).select("run", *KEY, "event")


@query("evt02_versions", f"WITH {O.SNAPSHOTS} SELECT company_id, external_id, content AS content_hash, min(run) AS run FROM snapshots GROUP BY ALL")
def versions(spark, sf_dir):
    rows = V.snapshots(spark, sf_dir).withColumnRenamed("content", "content_hash")
    half = rows.agg(F.min("run").alias("r"))
    first = inventory.add_versions(rows.select(*KEY, "content_hash", "run").limit(0), rows.join(F.broadcast(half), c("run") <= F.date_add("r", 15), "left_semi"))  # one row
    return inventory.add_versions(first, rows)


def _state_before(snapshots: DataFrame, last: DataFrame) -> DataFrame:
    """The inventory that all runs before each board's last one leave, in one pass."""
    w = Window.partitionBy(*KEY).orderBy("run")
    rows = snapshots.join(last, "company_id").where("run < last_run").withColumn("old", F.lag("content").over(w))
    latest = rows.groupBy("company_id").agg(F.max("run").alias("latest"))
    moved = F.when(c("old").isNull() | (c("old") != c("content")), c("run"))
    change = F.when(c("old").isNull(), "new").when(c("old") != c("content"), "changed").otherwise("unchanged")
    state = rows.withColumns({"moved": moved, "change": change}).groupBy(*KEY).agg(F.max_by("content", "run").alias("content_hash"), F.min("run").alias("first_seen"), F.max("run").alias("last_seen"), F.max("moved").alias("changed_at"), F.max_by("change", "run").alias("last_change_type"))
    return state.join(latest, "company_id").withColumn("active", c("last_seen") == c("latest")).drop("latest")


def _merged(spark, sf_dir):
    s = V.snapshots(spark, sf_dir)
    last = s.groupBy("company_id").agg(F.max("run").alias("last_run"))
    final = s.join(last, "company_id").where("run = last_run")
    before = _state_before(s, last)
    snapshot = final.select(*KEY, c("content").alias("content_hash"))
    complete = last.select("company_id", F.lit(True).alias("complete"))
    return before, snapshot, inventory.merge(before, snapshot, F.lit("9999-01-01").cast("date"), complete)


@query(
    "cdc01_snapshot_merge",
    f"""WITH {O.SNAPSHOTS}, h AS (SELECT *, lag(content) OVER (PARTITION BY company_id, external_id ORDER BY run) AS old, max(run) OVER (PARTITION BY company_id) AS last_run FROM snapshots),
    d AS (SELECT *, CASE WHEN run = last_run THEN DATE '9999-01-01' ELSE run END AS seen, CASE WHEN old IS NULL THEN 'new' WHEN old != content THEN 'changed' ELSE 'unchanged' END AS change FROM h)
    SELECT company_id, external_id, arg_max(content, run) AS content_hash, min(seen) AS first_seen, max(seen) AS last_seen, max(seen) FILTER (change != 'unchanged') AS changed_at, max(run) = max(last_run) AS active, arg_max(change, run) AS last_change_type FROM d GROUP BY ALL""",
)
def snapshot_merge(spark, sf_dir):
    return _merged(spark, sf_dir)[2]


@query(
    "cdc04_merge_counters",
    f"""WITH {O.SNAPSHOTS}, l AS (SELECT *, max(run) OVER (PARTITION BY company_id) AS last_run FROM snapshots), b AS (SELECT company_id, external_id, max(run) AS seen FROM l WHERE run < last_run GROUP BY ALL), p AS (SELECT company_id, max(run) AS run FROM l WHERE run < last_run GROUP BY 1),
    n AS (SELECT l.company_id, count(*) FILTER (b.seen IS NULL) AS new, count(b.seen) AS existing, count(*) AS now FROM l LEFT JOIN b USING (company_id, external_id) WHERE run = last_run GROUP BY 1), w AS (SELECT b.company_id, count(*) AS was FROM b JOIN p ON b.company_id = p.company_id AND b.seen = p.run GROUP BY 1)
    SELECT company_id, new, existing, greatest(0, coalesce(was, 0) - now) AS deactivated FROM n LEFT JOIN w USING (company_id)""",
)
def merge_counters(spark, sf_dir):
    before, snapshot, after = _merged(spark, sf_dir)
    return inventory.merge_counters(before, after, snapshot)


@query(
    "hlt02_run_health",
    f"""WITH {O.RESULTS}, r AS (SELECT *, lag(jobs_found) OVER (PARTITION BY company_id ORDER BY run) AS previous FROM results) SELECT company_id, run, jobs_found, previous, CASE WHEN previous > 0 THEN round((jobs_found - previous) / previous * 100, 2) END AS change_pct,
    CASE WHEN previous > 0 AND jobs_found < previous * (1 - 0.8::DOUBLE) THEN 'suspicious' ELSE 'healthy' END AS status, CASE WHEN previous > 0 AND jobs_found < previous * (1 - 0.8::DOUBLE) THEN 'large_job_count_drop' END AS category FROM r""",
)
def run_health(spark, sf_dir):
    return health.run_health(V.results(spark, sf_dir))


@query("win01_latest_result", f"WITH {O.RESULTS} SELECT company_id, run, jobs_found FROM results QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY run DESC) = 1")
def latest_result(spark, sf_dir):
    return V.results(spark, sf_dir).groupBy("company_id").agg(F.max_by("jobs_found", "run").alias("jobs_found"), F.max("run").alias("run"))


@query("win02_last_good", f"WITH {O.RESULTS} SELECT company_id, arg_max(jobs_found, run) AS last_good FROM results WHERE jobs_found > 0 GROUP BY 1")
def last_good(spark, sf_dir):
    return health.last_good(health.run_health(V.results(spark, sf_dir)))


@query("win03_history", f"WITH {O.RESULTS} SELECT company_id, run, jobs_found FROM results QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY run DESC) <= 10")
def history(spark, sf_dir):
    w = Window.partitionBy("company_id").orderBy(F.desc("run"))
    return V.results(spark, sf_dir).withColumn("i", F.row_number().over(w)).where("i <= 10").drop("i")


@query("crt02_detail_verdict", f"""WITH {O.PROBES}, t AS (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t, regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g') AS b FROM probes),
    k AS (SELECT *, list_filter(string_split(t, ' '), lambda x: len(x) >= 4 AND x NOT IN ('senior', 'junior', 'staff', 'lead')) AS toks FROM t)
    SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN status IN (401, 403, 429) THEN 'access_restricted' WHEN status IN (404, 410) THEN 'dead' WHEN status < 200 OR status >= 400 THEN 'http_error'
    WHEN NOT (content_type IS NULL OR regexp_matches(content_type, '(?i)text|html')) OR coalesce(body, '') = '' THEN 'reachable_unconfirmed' WHEN contains(lower(body), 'jobposting') THEN 'verified'
    WHEN t != '' AND (contains(b, t) OR (len(toks) > 0 AND len(list_filter(toks, lambda x: contains(b, x))) >= least(2, len(toks)))) THEN 'verified' ELSE 'reachable_unconfirmed' END AS verdict FROM k) GROUP BY 1""")
def detail_verdicts(spark, sf_dir):
    return V.probes(spark, sf_dir).groupBy(health.detail_verdict(c("status"), c("content_type"), c("title"), c("body")).alias("verdict")).agg(F.count("*").alias("n"))


@query(
    "crt01_completeness",
    f"""WITH {O.POSTINGS}, q AS (SELECT company_id, count(*) AS n, count(DISTINCT external_id) AS u, count(*) FILTER (job_url IS NOT NULL) / count(*) AS url_ratio FROM postings GROUP BY 1)
    SELECT company_id, CASE WHEN round(url_ratio, 4) < 0.5 THEN 'INVALID' WHEN n % 3 = 0 THEN 'UNVERIFIED' WHEN n % 3 = 1 THEN 'PARTIAL' ELSE 'CERTIFIED' END AS verdict FROM q""",
)
def completeness(spark, sf_dir):
    q = gate.board_quality(V.postings(spark, sf_dir))
    expected = F.when(c("n") % 3 == 1, c("n") + 1).when(c("n") % 3 == 2, c("n"))
    ratio = F.when(c("valid_url_ratio") < 0.5, 0.0).otherwise(1.0)
    return q.select("company_id", health.completeness_verdict(c("n"), c("unique_jobs"), expected, ratio, F.lit(0), c("n")).alias("verdict"))


@query(
    "rcn03_page_audit",
    f"""WITH {O.PAGE_LOG}, page AS (SELECT board, page_no, string_agg(external_id, ',' ORDER BY CAST(external_id AS VARCHAR)) AS print, count(external_id) AS ids FROM page_log GROUP BY ALL), again AS (SELECT board, print, count(*) AS c FROM page WHERE ids > 0 GROUP BY ALL HAVING count(*) > 1)
    SELECT board, 'blank_page' AS violation, count(*) AS n FROM page WHERE ids = 0 GROUP BY 1 UNION ALL SELECT board, 'repeated_page', CAST(sum(c - 1) AS BIGINT) FROM again GROUP BY 1
    UNION ALL SELECT board, 'row_without_id', count(*) FROM page_log WHERE external_id IS NULL GROUP BY 1 UNION ALL SELECT board, 'not_covered', max(total) - count(DISTINCT external_id) FROM page_log GROUP BY 1 HAVING count(DISTINCT external_id) < max(total)""",
)
def page_audit(spark, sf_dir):
    return health.audit_pages(V.page_log(spark, sf_dir))


@query(
    "rcn02_pass_evidence",
    f"""WITH {O.SNAPSHOTS}, f AS (SELECT company_id, external_id, min(run) AS run FROM snapshots GROUP BY ALL), r AS (SELECT company_id, run, count(*) AS unique_ids FROM snapshots GROUP BY ALL)
    SELECT r.company_id, r.run, unique_ids, (SELECT count(*) FROM f WHERE f.company_id = r.company_id AND f.run = r.run) AS added, (SELECT count(*) FROM f WHERE f.company_id = r.company_id AND f.run <= r.run) - unique_ids AS missing FROM r""",
)
def pass_evidence(spark, sf_dir):
    return health.pass_evidence(V.snapshots(spark, sf_dir))


@query("rcn01_merged_passes", f"WITH {O.SNAPSHOTS} SELECT company_id, external_id, arg_max(content, struct_pack(l := len(content), r := run)) AS content, count(DISTINCT run) AS passes FROM snapshots GROUP BY ALL")
def merged_passes(spark, sf_dir):
    return health.merge_passes(V.snapshots(spark, sf_dir), KEY, "content", "run")


_EVERY = f"""WITH {O.SNAPSHOTS}, n AS (SELECT *, dense_rank() OVER (PARTITION BY company_id ORDER BY run) AS k FROM snapshots WHERE run IS NOT NULL),
    w AS (SELECT DISTINCT company_id, run, k FROM n WHERE k > 1 AND k < (SELECT max(k) FROM n m WHERE m.company_id = n.company_id)),
    b AS (SELECT w.company_id, w.run, external_id FROM w JOIN n ON n.company_id = w.company_id AND n.k = w.k - 1),
    p AS (SELECT w.company_id, w.run, external_id FROM w JOIN n ON n.company_id = w.company_id AND n.k = w.k),
    a AS (SELECT w.company_id, w.run, external_id FROM w JOIN n ON n.company_id = w.company_id AND n.k = w.k + 1),
    s AS (SELECT * FROM b INTERSECT SELECT * FROM a), miss AS (SELECT * FROM s EXCEPT SELECT * FROM p), extra AS (SELECT * FROM p EXCEPT SELECT * FROM b EXCEPT SELECT * FROM a)"""


def _marks(spark, sf_dir):
    return health.window_marks(V.snapshots(spark, sf_dir), "company_id", "external_id", "run")


@query(
    "rcn04_window_verdict",
    f"""{_EVERY}, c AS (SELECT company_id, run, (SELECT count(*) FROM s WHERE s.company_id = w.company_id AND s.run = w.run) AS stable, (SELECT count(*) FROM miss m WHERE m.company_id = w.company_id AND m.run = w.run) AS missing,
    (SELECT count(*) FROM extra x WHERE x.company_id = w.company_id AND x.run = w.run) AS extra FROM w) SELECT *, CASE WHEN missing = 0 AND extra = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM c""",
)
def window_verdict(spark, sf_dir):
    return health.window_verdicts(_marks(spark, sf_dir), "company_id", "run")


@query("set01_stable", f"{_EVERY} SELECT * FROM s")
def stable(spark, sf_dir):
    return _marks(spark, sf_dir).where("before and after").select("company_id", "run", "external_id")


@query("set02_missing", f"{_EVERY} SELECT * FROM miss")
def missing_ids(spark, sf_dir):
    return _marks(spark, sf_dir).where("before and after and not produced").select("company_id", "run", "external_id")


@query("set03_symmetric", f"{_EVERY} SELECT company_id, run, count(*) AS n FROM ((SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL (SELECT * FROM a EXCEPT SELECT * FROM b)) GROUP BY 1, 2")
def symmetric(spark, sf_dir):
    return _marks(spark, sf_dir).where("before != after").groupBy("company_id", "run").agg(F.count("*").alias("n"))


@query("set05_ordered_union", f"WITH {O.SNAPSHOTS}, f AS (SELECT company_id, external_id, content, min(run) AS r FROM snapshots GROUP BY ALL) SELECT company_id, external_id, string_agg(content, ',' ORDER BY r, content) AS contents FROM f GROUP BY ALL")
def ordered_union(spark, sf_dir):
    firsts = V.snapshots(spark, sf_dir).groupBy(*KEY, "content").agg(F.min("run").alias("r"))
    return firsts.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "content"))), lambda x: x["content"]), ",").alias("contents"))


@query("src14_richest", f"WITH {O.POSTINGS} SELECT company_id, job_url, ord FROM postings QUALIFY row_number() OVER (PARTITION BY company_id, job_url ORDER BY len(coalesce(title, '')) + len(coalesce(location, '')) + len(coalesce(description, '')) DESC, ord) = 1")
def richest(spark, sf_dir):
    size = F.length(T.blank(c("title"))) + F.length(T.blank(c("location"))) + F.length(T.blank(c("description")))
    return inventory.first_by(V.postings(spark, sf_dir).withColumn("size", size), ["company_id", "job_url"], [F.desc("size"), "ord"]).select("company_id", "job_url", "ord")


@query(
    "rcn05_best_attempt",
    f"""WITH {O.POSTINGS}, a AS (SELECT company_id, ord % 3 AS attempt, count(*) FILTER (job_url IS NOT NULL) AS usable, count(*) AS n FROM postings GROUP BY ALL) SELECT company_id, attempt, usable, n FROM a QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY usable DESC, usable / n DESC, n DESC, attempt) = 1""",
)
def best_attempt(spark, sf_dir):
    a = V.postings(spark, sf_dir).groupBy("company_id", (c("ord") % 3).alias("attempt")).agg(F.count_if(R.valid_url(c("job_url"))).alias("usable"), F.count("*").alias("n"))
    return inventory.first_by(a, ["company_id"], [F.desc("usable"), F.desc(c("usable") / c("n")), F.desc("n"), "attempt"])


# --- Near duplicates ---------------------------------------------------------------------------------------------


@query(
    "join13_similar_pairs",
    f"""WITH t AS (SELECT DISTINCT lang AS block, doc_id AS k, list_sort(list_filter(list_distinct(string_split({O.norm("text")}, ' ')), lambda x: x != '')) AS toks FROM documents),
    u AS (SELECT block, k, len(toks) AS n, unnest(toks) AS tok FROM t), s AS (SELECT a.block, a.k AS a, b.k AS b, a.n AS na, b.n AS nb, count(*) AS m FROM u a JOIN u b ON a.block = b.block AND a.tok = b.tok AND a.k < b.k WHERE least(a.n, b.n) >= 0.9 * greatest(a.n, b.n) GROUP BY ALL)
    SELECT block, a, b, m / (na + nb - m) AS jaccard FROM s WHERE m / (na + nb - m) >= 0.9""",
)
def similar_pairs(spark, sf_dir):
    return neardup.similar_pairs(V.read(spark, sf_dir, "documents"), "lang", "doc_id", "text")


def _to_mark(spark, sf_dir):
    """The stored analysis with what marking compares."""
    p = V.postings(spark, sf_dir).select(*KEY, "location", "description")
    return _analyses(spark, sf_dir).withColumn("first_seen", c("first_seen_day")).join(p, KEY)


@query("ndp01_near_duplicates")
def near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(_to_mark(spark, sf_dir))


@query("ndp01_marked_analysis")
def marked_analysis(spark, sf_dir):
    """CDC-11 over the marks that NDP-01 finds."""
    a = _to_mark(spark, sf_dir)
    marked = runs.mark_duplicates(a.select(*KEY, "relevance_status", "is_relevant", "filter_reason"), neardup.near_duplicates(a))
    return marked.groupBy("relevance_status", "is_relevant", F.col("duplicate_of_external_id").isNotNull().alias("marked")).agg(F.count("*").alias("n"))


# --- Matching ----------------------------------------------------------------------------------------------------


def _official(spark, sf_dir):
    """A board's own list, as two in three postings in another order with their cards' texts, against the postings that are active."""
    p = V.postings(spark, sf_dir)
    records = p.where("ord % 3 != 1").select((c("ord") * 7919 % 1_000_003 * 10_000_000 + c("ord")).alias("r"), "title", F.when(c("ord") % 4 != 0, F.concat_ws(" ", "title", "location")).alias("context"), "ord")
    return records, p.where("active").select(c("ord").alias("j"), "title", "location")


@query("join15_match")
def match(spark, sf_dir):
    records, jobs = _official(spark, sf_dir)
    return matching.one_to_one(records, jobs)


@query("join15_missing")
def missing(spark, sf_dir):
    records, jobs = _official(spark, sf_dir)
    probes = records.join(V.probes(spark, sf_dir).where("turn = 0"), c("ord") == c("conv_id")).select("r", "status", "body")
    judged = matching.missing_records(records, matching.one_to_one(records, jobs), probes)
    return judged.groupBy("verdict", "reason").agg(F.count("*").alias("n"))


# --- Pages -------------------------------------------------------------------------------------------------------


@query("src21_anchor_counts", "SELECT page_id, CAST(len(regexp_extract_all(html, '<a [^>]*href=')) AS BIGINT) AS anchors FROM pages WHERE regexp_matches(html, '<a [^>]*href=')")
def anchor_counts(spark, sf_dir):
    return extract.anchors(V.pages(spark, sf_dir)).groupBy("page_id").agg(F.count("*").alias("anchors"))


@query("src21_harvest_links")
def harvest_links(spark, sf_dir):
    return extract.harvest_links(V.pages(spark, sf_dir))


@query("src20_embedded_json")
def embedded_json(spark, sf_dir):
    return extract.embedded_json(V.pages(spark, sf_dir))


@query("srt08_listing_links")
def listing_links(spark, sf_dir):
    return extract.listing_links(V.pages(spark, sf_dir))


@query("src17_site_rules", "SELECT page_id, regexp_extract(url, '://[^/?#]*/([a-z]{2})/\\d+', 1) AS site_id FROM pages WHERE regexp_matches(url, '://[^/?#]*example[.](com|net|org)[^?#]*/[a-z]{2}/\\d+')")
def site_rules(spark, sf_dir):
    return extract.by_site_rules(V.pages(spark, sf_dir), "url", extract.SITE_RULES).where("site_id is not null").select("page_id", "site_id")


@query("dsc01_hosts", "SELECT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1")
def hosts(spark, sf_dir):
    return V.pages(spark, sf_dir).groupBy(T.url_host(c("url")).alias("host")).agg(F.count("*").alias("n"))


@query("src18_nested_json")
def nested_json(spark, sf_dir):
    p = V.postings(spark, sf_dir)
    body = F.to_json(F.struct(F.array(F.struct(c("title").alias("jobTitle"), c("external_id").alias("id"), c("location").alias("city"), c("job_url").alias("url"), c("posted_at").alias("postedOn"))).alias("results")))
    return extract.harvest_json(p.select("ord", body.alias("body")), "ord", "body")


@query("loc03_structured")
def structured(spark, sf_dir):
    p = V.postings(spark, sf_dir)
    raw = F.to_json(F.struct(F.struct(c("location").alias("city"), V.pick(c("ord"), ["IN", "US", "India", None, "GB"]).alias("countryCode"), V.pick(c("ord"), ["KA", "MH", None]).alias("state")).alias("primaryLocation")))
    return location.structured_evidence(location.structured_values(p.select("external_id", raw.alias("raw")), "external_id", "raw"))
