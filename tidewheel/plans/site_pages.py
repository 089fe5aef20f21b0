"""Registered queries over pages that hold postings, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators import canonical, extract, pages
from tidewheel.plans import views as V
from tidewheel.plans.queries import c, query

ROLES = ["Data Engineer", "Product Manager", "Security Analyst", "Platform Architect", "Sales Director"]
TOWNS = ["Pune", "Chennai", "Noida", "Mumbai"]
HOSTS = [s["host"] for s in pages.SITES]


def job_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages as they would look on boards: (page_id, url, html).

    Every page gets JSON-LD (a posting in two of three, once with a list of
    types), embedded state with one position, a detail link in a card and, by the
    page's number, the listing of one of five sites.
    """
    k = c("page_id")
    role, town, n = V.pick(k, ROLES), V.pick(k, TOWNS), k.cast("string")
    kind = V.pick(k, ['"JobPosting"', '"Organization"', '["Thing", "JobPosting"]'])
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    ld = say('<script type="application/ld+json">{"@graph": [{"@type": ', kind, ', "title": "', role, ' LD", "identifier": {"value": "L', n, '"}, "url": "/ld/', n, '", "jobLocation": [{"address": {"addressLocality": "', town, '", "addressCountry": "IN"}}], "description": "<p>Run &amp; own it</p>", "datePosted": "2026-03-04"}]}</script>')
    state = say('<script id="__NEXT_DATA__">{"props": {"jobs": [{"name": "', role, ' State", "positionId": ', n, ', "location": "', town, ', India", "jobUrl": "apply/', n, '"}, {"name": "Home"}]}}</script><script type="application/json">{"broken": </script>')
    card = say('<div class="card"><h3>', role, " ", n, "</h3><p>", town, ', Karnataka, India</p><p>2026-02-01</p><a href="/careers/details/', n, '">View details</a></div>')
    apple = say('<ul><li><a href="/en-in/details/', n, '-11/x/">', role, "</a> Location ", town, " Role Number: 7 ", '3 Jan 2026</li></ul><a href="/en-in/details/', n, '-11/x/">Share</a>')
    amazon = say('<div><h3><a href="/en/jobs/', n, '/x">', role, "</a></h3> Location: ", town, ", IND | Posted: 5 days ago</div>")
    meta = say('<div><a href="/profile/job_details/', n, '/">', role, "</a> ", town, ", India</div>")
    kula = say('<div><h3>', role, "</h3><p>Platform</p><p>", town, ', Maharashtra, India</p><p>Full Time • Hybrid</p><a href="/acme/', n, '/apply">Apply now</a><a href="/other/', n, '9/apply">Apply now</a></div>')
    rows = say("<p>Results 1 – 1 of ", n, "</p><table><tr><td>20", n, '</td><td><a href="/x/job/A-b/', n, '/">', role, "</a></td><td>", town, ", IN</td><td>10 Aug 2026</td></tr></table>")
    site = F.get(F.array(apple, amazon, meta, kula, rows), (k % 5).cast("int"))
    url = say("https://", V.pick(k, HOSTS), "/acme")
    return V.pages(spark, sf_dir).select(k, url.alias("url"), F.regexp_replace("html", "</body>", "").alias("_html"), say(ld, state, card, site).alias("_more")).select("page_id", "url", F.concat("_html", "_more", F.lit("</body></html>")).alias("html"))


def _sql(expr: str) -> str:
    pick = lambda values: "(CASE page_id % " + str(len(values)) + "".join(f" WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END)"
    return f"WITH p AS (SELECT page_id, CAST(page_id AS VARCHAR) AS n, {pick(ROLES)} AS role, {pick(TOWNS)} AS town, {pick(HOSTS)} AS host FROM pages) {expr}"


@query("src19_jsonld", _sql("SELECT page_id, 'L' || n AS external_id, role || ' LD' AS title, town || ', IN' AS location, 'Run & own it' AS description, 'https://' || host || '/ld/' || n AS job_url, '2026-03-04' AS posted_at FROM p WHERE page_id % 3 != 1"))
def jsonld(spark, sf_dir):
    return pages.jsonld(job_pages(spark, sf_dir)).drop("script", "obj")


@query("src20_state_scripts", _sql("SELECT page_id, count(*) AS scripts FROM p, (SELECT unnest([1, 2]) AS s) GROUP BY 1"))
def state_scripts(spark, sf_dir):
    """Of a page's three scripts with state one isn't JSON."""
    return extract.embedded_json(job_pages(spark, sf_dir)).groupBy("page_id").agg(F.count("*").alias("scripts"))


def _state(spark, sf_dir):
    return pages._script_bodies(job_pages(spark, sf_dir)).where("type = ''")


@query("src10_positions", _sql("SELECT page_id, n AS external_id, role || ' State' AS title, town || ', India' AS location, 'https://' || host || '/apply/' || n AS job_url FROM p"))
def positions(spark, sf_dir):
    return pages.harvest_positions(_state(spark, sf_dir), "page_id", "body", "url").select(c("key").cast("long").alias("page_id"), "external_id", "title", "location", "job_url")


@query("src18_records", _sql("SELECT page_id, n AS external_id, role || ' State' AS title, town || ', India' AS location, 'https://' || host || '/apply/' || n AS job_url FROM p"))
def records(spark, sf_dir):
    return pages.harvest_objects(_state(spark, sf_dir), "page_id", "body", "url").select(c("key").cast("long").alias("page_id"), "external_id", "title", "location", "job_url")


_LISTED = _sql("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'apple' WHEN 1 THEN 'amazon' WHEN 2 THEN 'meta' WHEN 3 THEN 'kula' ELSE 'successfactors' END AS site,
  CASE WHEN page_id % 5 = 0 THEN n || '-11' ELSE n END AS external_id, role AS title,
  CASE page_id % 5 WHEN 0 THEN town WHEN 1 THEN town || ', IND' WHEN 2 THEN town || ', India' WHEN 3 THEN town || ', Maharashtra, India' ELSE town || ', IN' END AS location,
  CASE page_id % 5 WHEN 0 THEN '3 Jan 2026' WHEN 1 THEN '5 days ago' WHEN 4 THEN '10 Aug 2026' END AS posted_at,
  'https://' || host || CASE page_id % 5 WHEN 0 THEN '/en-in/details/' || n || '-11/x/' WHEN 1 THEN '/en/jobs/' || n || '/x' WHEN 2 THEN '/profile/job_details/' || n || '/' WHEN 3 THEN '/acme/' || n ELSE '/x/job/A-b/' || n || '/' END AS job_url,
  CASE WHEN page_id % 5 = 3 THEN 'Platform' END AS department, CASE WHEN page_id % 5 = 3 THEN 'Full Time' END AS employment_type, CASE WHEN page_id % 5 = 3 THEN 'Hybrid' END AS work_type,
  CASE WHEN page_id % 5 = 4 THEN '20' || n END AS req_id FROM p""")


@query("src23_site_rules", _LISTED)
def listed(spark, sf_dir):
    rows = pages.harvest_by_rules(job_pages(spark, sf_dir), pages.site_rules(spark))
    return rows.select("page_id", "site", "external_id", "title", "location", "posted_at", "job_url", "department", *(F.try_element_at("fields", F.lit(f)).alias(f) for f in ("employment_type", "work_type", "req_id")))


@query("join16_rule_hosts", _sql("SELECT host, count(*) AS n FROM p WHERE page_id % 5 IN (0, 3) GROUP BY 1"))
def rule_hosts(spark, sf_dir):
    """Pages of two of the rule rows; those of other hosts have no rule."""
    rules = pages.site_rules(spark).where(c("site").isin("apple", "kula"))
    return pages.harvest_by_rules(job_pages(spark, sf_dir), rules).groupBy(F.get(F.split("job_url", "/"), 2).alias("host")).agg(F.countDistinct("page_id").alias("n"))


@query("src23_totals", _sql("SELECT page_id, CASE WHEN page_id % 5 = 4 THEN page_id END AS total FROM p"))
def totals(spark, sf_dir):
    return pages.results_total(job_pages(spark, sf_dir))


@query("src22_cards", _sql("SELECT page_id, 'https://' || host || '/careers/details/' || n AS external_id, role || ' ' || n AS title, town || ', Karnataka, India' AS location FROM p"))
def cards(spark, sf_dir):
    rules = spark.createDataFrame([(h, "div.card", "h3", "p", "a") for h in HOSTS], "host string, card string, title string, location string, link string")
    return pages.harvest_cards(job_pages(spark, sf_dir), rules).select("page_id", "external_id", "title", "location")


_OFFICIAL = _sql("""SELECT page_id, extractor, count(*) AS n, min(title) AS title FROM (
  SELECT page_id, 'jsonld' AS extractor, role || ' LD' AS title FROM p WHERE page_id % 3 != 1
  UNION ALL SELECT page_id, 'embedded_json', role || ' State' FROM p UNION ALL SELECT page_id, 'embedded_json', role || ' LD' FROM p
  UNION ALL SELECT page_id, 'links', role || ' ' || n FROM p
  UNION ALL SELECT page_id, 'links', role FROM p WHERE page_id % 5 IN (0, 1, 4)) GROUP BY ALL""")


@query("src24_official", _OFFICIAL)
def official(spark, sf_dir):
    return pages.official(job_pages(spark, sf_dir)).where("extractor != 'links' or title not rlike '^(Apply|Share)'").groupBy("page_id", "extractor").agg(F.count("*").alias("n"), F.min("title").alias("title"))


@query("src24_links", _sql("SELECT page_id, n AS external_id, role || ' ' || n AS title, town || ', Karnataka, India' AS location, '2026-02-01' AS posted_at FROM p"))
def official_links(spark, sf_dir):
    rows = pages.official(job_pages(spark, sf_dir).withColumn("html", F.regexp_extract("html", "(<div class=.card.>.*?</div>)", 1)))
    return rows.select("page_id", "external_id", "title", "location", "posted_at")


@query("src25_static_page", _sql("SELECT page_id, extractor, count(*) AS n FROM (SELECT page_id, 'jsonld' AS extractor FROM p WHERE page_id % 3 != 1 UNION ALL SELECT page_id, 'embedded_json' FROM p UNION ALL SELECT page_id, 'embedded_json' FROM p) GROUP BY ALL"))
def static_page(spark, sf_dir):
    return pages.static_page(job_pages(spark, sf_dir)).where("extractor != 'links'").groupBy("page_id", "extractor").agg(F.count("*").alias("n"))


@query("src25_strict_page", _sql("SELECT page_id, 'https://' || host || '/careers/details/' || n AS job_url, role || ' ' || n AS title FROM p"))
def strict_page(spark, sf_dir):
    return pages.static_page(job_pages(spark, sf_dir), strict=True).where("job_url like '%/careers/details/%'").select("page_id", "job_url", "title")


@query("src26_captured", _sql("SELECT page_id AS capture_id, 'https://' || host || '/acme' AS response_url, CASE WHEN page_id % 2 = 0 THEN 'json' ELSE 'jsonld' END AS extractor, CASE WHEN page_id % 2 = 0 THEN role || ' State' ELSE role || ' LD' END AS title FROM p WHERE page_id % 2 = 0 OR page_id % 3 != 1"))
def captured(spark, sf_dir):
    body = F.regexp_extract("html", '<script id="__NEXT_DATA__">(.*?)</script>', 1)
    even = c("page_id") % 2 == 0
    caught = job_pages(spark, sf_dir).select(c("page_id").alias("capture_id"), c("url").alias("response_url"), F.when(even, "application/json; charset=utf-8").otherwise("text/html").alias("content_type"), F.when(even, body).otherwise(c("html")).alias("body"))
    return pages.captured(caught).where("extractor in ('json', 'jsonld')").select("capture_id", "response_url", "extractor", "title")


@query("set06_all_outlinks", _sql("SELECT page_id, CASE WHEN page_id % 5 = 3 THEN 3 ELSE 2 END AS n FROM p WHERE page_id % 5 IN (3, 4)"))
def all_outlinks(spark, sf_dir):
    rows = pages.outlinks(job_pages(spark, sf_dir).where("page_id % 5 in (3, 4)"), ["kula.ai", "payu.in"])
    return rows.where("target rlike 'careers/details|apply|/x/job/'").groupBy("page_id").agg(F.count("*").cast("int").alias("n"))


_SITES = ["phenom", "goldman", "atlassian", "trakstar", "kula", "avature", "eightfold"]
_LINKS = ["/us/en/job/R{k}/x", "/roles/{k}", "/company/careers/details/{k}", "/jobs/oa{k}", "/acme/jobs/{k}", "/careers/JobDetail/Cook/{k}", "/careers/job/{k}"]


@query(
    "src17_canonical",
    f"""WITH e AS (SELECT event_id AS k, CAST(event_id AS VARCHAR) AS n, event_id % 7 AS s, event_id // 7 % 3 AS form FROM events), p AS (SELECT *, CASE s {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_SITES))} END AS site FROM e)
    SELECT k, site, CASE WHEN form = 0 THEN CASE s WHEN 0 THEN 'R' || n WHEN 3 THEN 'oa' || n WHEN 6 THEN 'own' ELSE n END WHEN form = 1 THEN CASE WHEN s = 0 THEN lpad(n, 9, '0') ELSE n END ELSE 'own' END AS external_id,
      CASE WHEN form = 0 THEN CASE s WHEN 0 THEN 'https://h.example/us/en/job/R' || n || '/x' WHEN 1 THEN 'https://higher.gs.com/roles/' || n WHEN 2 THEN 'https://www.atlassian.com/company/careers/details/' || n WHEN 3 THEN 'https://h.example/jobs/oa' || n
        WHEN 4 THEN 'https://careers.kula.ai/acme/' || n WHEN 5 THEN 'https://h.example/careers/JobDetail/Cook/' || n ELSE 'https://own.example/careers/job/' || n END
      WHEN form = 1 THEN CASE s WHEN 1 THEN 'https://higher.gs.com/roles/' || n WHEN 2 THEN 'https://www.atlassian.com/company/careers/details/' || n WHEN 5 THEN 'https://own.example/en_US/careers/JobDetail?jobId=' || n END
      ELSE 'https://h.example/about/' || n END AS job_url
    FROM p WHERE form = 0 OR (form = 1 AND s != 3) OR (form = 2 AND s IN (0, 4, 6))""",
)
def canonical_rows(spark, sf_dir):
    """Every event as a posting of one of seven sites: with its link, without a link but an id of the right form, or with neither."""
    k, n = c("event_id"), c("event_id").cast("string")
    form = F.floor(k / 7) % 3
    site = V.pick(k, _SITES)
    link = F.concat(F.when(site == "eightfold", "https://t.eightfold.ai").otherwise("https://h.example"), F.replace(V.pick(k, _LINKS), F.lit("{k}"), n))
    own = F.when(form == 1, F.when(site == "phenom", F.lpad(n, 9, "0")).otherwise(n)).when((form == 2) | (site == "eightfold"), "own")
    rows = V.read(spark, sf_dir, "events").select(k.alias("ord"), site.alias("site"), F.lit("acme").alias("company_id"), own.alias("external_id"), F.concat(F.lit("T"), n).alias("title"), F.lit(None).cast("string").alias("location"), F.when(form == 0, link).when(form == 2, F.concat(F.lit("https://h.example/about/"), n)).alias("job_url"))
    boards = spark.createDataFrame([("acme", "acme", "https://own.example/", None)], "company_id string, tenant string, base string, locale string")
    return canonical.canonicalize(rows, canonical.canonical_rules(spark), boards).select(c("ord").alias("k"), "site", "external_id", "job_url")
