"""Registered queries over run history, stored analyses and reports, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import profile as P
from tidewheel.functions import text as T
from tidewheel.operators import health, inventory, relevance
from tidewheel.plans import oracle as O
from tidewheel.plans import views as V
from tidewheel.plans.queries import _EVENTS, KEY, c, query

_ANALYSIS = f"""WITH {O.POSTINGS}, analysis AS (SELECT company_id, external_id, ord, CAST(ord * 7 % 100 AS DOUBLE) AS score, ord % 9 = 0 AS hard_filtered, CASE WHEN ord % 5 = 0 THEN NULL ELSE md5(title) END AS source_hash,
  CASE WHEN ord % 8 = 1 THEN company_id END AS duplicate_of FROM postings WHERE ord % 4 != 3)"""


def _analysis(spark, sf_dir) -> DataFrame:
    """A stored analysis of three quarters of the postings."""
    p = V.postings(spark, sf_dir).where("ord % 4 != 3")
    return p.select(*KEY, "ord", (c("ord") * 7 % 100).cast("double").alias("score"), (c("ord") % 9 == 0).alias("hard_filtered"), F.when(c("ord") % 5 != 0, F.md5("title")).alias("source_hash"), F.when(c("ord") % 8 == 1, c("company_id")).alias("duplicate_of"))


@query("join01_inner", f"{_ANALYSIS} SELECT p.external_id, p.title, a.score FROM postings p JOIN analysis a USING (company_id, external_id) WHERE p.active")
def join_inner(spark, sf_dir):
    return V.postings(spark, sf_dir).where("active").join(_analysis(spark, sf_dir).drop("ord"), KEY).select("external_id", "title", "score")


@query("join02_left", f"{_ANALYSIS} SELECT p.external_id, p.title, a.score FROM postings p LEFT JOIN analysis a USING (company_id, external_id) WHERE p.active")
def join_left(spark, sf_dir):
    return V.postings(spark, sf_dir).where("active").join(_analysis(spark, sf_dir).drop("ord"), KEY, "left").select("external_id", "title", "score")


@query("join03_pending", f"{_ANALYSIS} SELECT p.external_id FROM postings p WHERE NOT EXISTS (SELECT 1 FROM analysis a WHERE a.external_id = p.external_id AND a.company_id = p.company_id AND a.source_hash IS NOT NULL)")
def join_pending(spark, sf_dir):
    return V.postings(spark, sf_dir).join(_analysis(spark, sf_dir).where("source_hash is not null"), KEY, "left_anti").select("external_id")


@query("join04_dedup_candidates", f"{_ANALYSIS} SELECT p.external_id, a.score FROM postings p JOIN analysis a USING (company_id, external_id) WHERE p.active AND NOT a.hard_filtered")
def dedup_candidates(spark, sf_dir):
    return V.postings(spark, sf_dir).where("active").join(_analysis(spark, sf_dir).where("not hard_filtered").drop("ord"), KEY).select("external_id", "score")


@query("join06_versions", f"""{_EVENTS}, v AS (SELECT company_id, external_id, content, min(run) AS first_run FROM snapshots GROUP BY ALL)
    SELECT e.run, e.company_id, e.external_id, e.event, v.first_run FROM events_ e JOIN v USING (company_id, external_id, content) WHERE e.event IN ('new', 'changed')""")
def with_versions(spark, sf_dir):
    s = V.snapshots(spark, sf_dir)
    v = s.groupBy(*KEY, "content").agg(F.min("run").alias("first_run"))
    return inventory.replay(s).where("event in ('new', 'changed')").join(v, [*KEY, "content"]).select("run", *KEY, "event", "first_run")


@query("cdc06_upsert", f"{_ANALYSIS} SELECT external_id, CASE WHEN ord % 2 = 0 THEN score + 1 ELSE score END AS score FROM analysis UNION ALL SELECT external_id, 0.0 FROM postings WHERE ord % 4 = 3")
def upsert(spark, sf_dir):
    old = _analysis(spark, sf_dir).select(*KEY, "ord", "score")
    new = old.where("ord % 2 = 0").select(*KEY, (c("score") + 1).alias("score"))
    added = V.postings(spark, sf_dir).where("ord % 4 = 3").select(*KEY, F.lit(0.0).alias("score"))
    return inventory.upsert(old.drop("ord"), new.unionByName(added), KEY).select("external_id", "score")


@query("cdc10_reset_duplicates", f"{_ANALYSIS} SELECT external_id, {O.band('score', 'hard_filtered')} AS status FROM analysis WHERE duplicate_of IS NOT NULL UNION ALL SELECT external_id, 'kept' FROM analysis WHERE duplicate_of IS NULL")
def reset_duplicates(spark, sf_dir):
    return _analysis(spark, sf_dir).select("external_id", F.when(c("duplicate_of").isNotNull(), relevance.band(c("score"), c("hard_filtered"))).otherwise("kept").alias("status"))


@query("cdc13_evolution", f"{_ANALYSIS} SELECT external_id, score, coalesce(duplicate_of, 'none') AS duplicate_of FROM analysis WHERE ord % 2 = 0 UNION ALL SELECT external_id, score, 'none' FROM analysis WHERE ord % 2 = 1")
def evolution(spark, sf_dir):
    a = _analysis(spark, sf_dir)
    old = a.where("ord % 2 = 1").select("external_id", "score")
    return a.where("ord % 2 = 0").select("external_id", "score", "duplicate_of").unionByName(old, allowMissingColumns=True).withColumn("duplicate_of", F.coalesce("duplicate_of", F.lit("none")))


@query("cdc15_baseline", f"WITH {O.RESULTS}, m AS (SELECT *, max(run) OVER () AS last FROM results) SELECT company_id, coalesce(arg_max(jobs_found, run) FILTER (run = last AND jobs_found > 0), arg_max(jobs_found, run) FILTER (run < last)) AS baseline FROM m GROUP BY 1 HAVING baseline IS NOT NULL")
def baseline(spark, sf_dir):
    r = V.results(spark, sf_dir)
    last = r.agg(F.max("run").alias("last"))
    r = r.join(F.broadcast(last), F.lit(True))  # one row
    old = r.where("run < last").groupBy("company_id").agg(F.max_by("jobs_found", "run").alias("old"))
    new = r.where("run = last and jobs_found > 0").select("company_id", c("jobs_found").alias("new"))
    return old.join(new, "company_id", "full_outer").select("company_id", F.coalesce("new", "old").alias("baseline"))


@query("cdc05_completeness", f"WITH {O.RESULTS}, r AS (SELECT *, lag(jobs_found) OVER (PARTITION BY company_id ORDER BY run) AS p FROM results) SELECT company_id, run, jobs_found > 0 AND NOT coalesce(p > 0 AND jobs_found < p * (1 - 0.8::DOUBLE), false) AS complete FROM r")
def complete(spark, sf_dir):
    h = health.run_health(V.results(spark, sf_dir))
    return h.select("company_id", "run", inventory.completeness(c("jobs_found"), c("previous"), F.lit(False)).alias("complete"))


@query("srt03_run_jobs", f"{_EVENTS} SELECT company_id, external_id, event FROM events_ WHERE run = (SELECT max(run) FROM events_) ORDER BY CASE event WHEN 'new' THEN 0 WHEN 'changed' THEN 1 WHEN 'closed' THEN 2 ELSE 3 END, company_id, external_id LIMIT 50")
def run_jobs(spark, sf_dir):
    s = V.snapshots(spark, sf_dir)
    last = s.agg(F.max("run").alias("run"))
    e = inventory.replay(s).join(F.broadcast(last), "run", "left_semi")  # one row
    order = F.when(c("event") == "new", 0).when(c("event") == "changed", 1).when(c("event") == "closed", 2).otherwise(3)
    return e.orderBy(order, *KEY).limit(50).select(*KEY, "event")


@query("qry03_event_mix", f"{_EVENTS} SELECT company_id, event, count(*) AS n, count(DISTINCT external_id) AS keys FROM events_ WHERE content ILIKE '%c%' GROUP BY ALL")
def event_mix(spark, sf_dir):
    return inventory.replay(V.snapshots(spark, sf_dir)).where(c("content").ilike("%c%")).groupBy("company_id", "event").agg(F.count("*").alias("n"), F.countDistinct("external_id").alias("keys"))


@query("srt06_drops", f"""WITH {O.RESULTS}, {O.BOARDS}, r AS (SELECT *, lag(jobs_found) OVER (PARTITION BY company_id ORDER BY run) AS p FROM results), w AS (SELECT company_id, count(*) FILTER (p > 0 AND jobs_found < p * (1 - 0.8::DOUBLE)) AS drops FROM r GROUP BY 1)
    SELECT company_id, drops FROM w JOIN boards USING (company_id) WHERE drops > 0 ORDER BY drops DESC, rank LIMIT 8""")
def drops(spark, sf_dir):
    h = health.run_health(V.results(spark, sf_dir)).groupBy("company_id").agg(F.count_if(c("status") == "suspicious").alias("drops")).where("drops > 0")
    return h.join(V.boards(spark, sf_dir), "company_id").orderBy(F.desc("drops"), "rank").limit(8).select("company_id", "drops")


@query("srt10_runs", f"WITH {O.RESULTS} SELECT run, count(*) AS companies, sum(jobs_found) AS jobs FROM results GROUP BY 1 ORDER BY run DESC LIMIT 20")
def runs(spark, sf_dir):
    return V.results(spark, sf_dir).groupBy("run").agg(F.count("*").alias("companies"), F.sum("jobs_found").alias("jobs")).orderBy(F.desc("run")).limit(20)


@query("win04_latest_run", f"WITH {O.RESULTS} SELECT company_id, max(run) AS run FROM results GROUP BY 1")
def latest_run(spark, sf_dir):
    return V.results(spark, sf_dir).groupBy("company_id").agg(F.max("run").alias("run"))


@query("agg08_health_summary", f"WITH {O.RESULTS}, r AS (SELECT *, lag(jobs_found) OVER (PARTITION BY company_id ORDER BY run) AS p FROM results) SELECT CASE WHEN p > 0 AND jobs_found < p * (1 - 0.8::DOUBLE) THEN 'suspicious' ELSE 'healthy' END AS status, count(*) AS n, sum(jobs_found) AS jobs FROM r GROUP BY 1")
def health_summary(spark, sf_dir):
    return health.run_health(V.results(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"), F.sum("jobs_found").alias("jobs"))


@query("flt19_scope", f"WITH {O.BOARDS}, asked AS (SELECT DISTINCT source AS company_id FROM documents) SELECT company_id, 'selected' AS state FROM boards WHERE enabled AND company_id IN (SELECT company_id FROM asked) UNION ALL SELECT company_id, 'unknown' FROM asked WHERE company_id NOT IN (SELECT company_id FROM boards)")
def scope(spark, sf_dir):
    b, asked = V.boards(spark, sf_dir), V.read(spark, sf_dir, "documents").select(c("source").alias("company_id")).distinct()
    known = b.where("enabled").join(asked, "company_id", "left_semi").select("company_id", F.lit("selected").alias("state"))
    return known.unionByName(asked.join(b, "company_id", "left_anti").select("company_id", F.lit("unknown").alias("state")))


@query("flt18_companies", f"WITH {O.BOARDS} SELECT company_id, company_name FROM boards WHERE (company_name ILIKE '%1%' OR company_id ILIKE '%1%') AND enabled")
def company_filter(spark, sf_dir):
    from tidewheel.functions.predicates import text_search

    return V.boards(spark, sf_dir).where(text_search("1", c("company_name"), c("company_id")) & c("enabled")).select("company_id", "company_name")


@query("set07_shard_reports", f"WITH {O.RESULTS} SELECT company_id, arg_max(jobs_found, struct_pack(a := month(run) % 4, b := run)) AS jobs_found FROM results GROUP BY 1")
def shard_reports(spark, sf_dir):
    return V.results(spark, sf_dir).groupBy("company_id").agg(F.max_by("jobs_found", F.struct(F.month("run") % 4, "run")).alias("jobs_found"))


_LOW, _HIGH = "l_quantity % 12", "CASE WHEN l_linenumber % 2 = 0 THEN l_quantity % 12 + l_linenumber END"
_Y, _R = P.YEARS, P.REJECT_YEARS


@query(
    "scl21_experience_points",
    f"""WITH t AS (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE {_LOW} END AS low, {_HIGH} AS high FROM lineitem), p AS (SELECT CASE WHEN low IS NULL THEN 18.0 WHEN low >= {_R} THEN 0.0 WHEN high IS NOT NULL AND low <= {_Y} AND high >= {_Y} THEN 20.0
    WHEN high IS NULL AND low BETWEEN 2 AND {_Y} THEN 20.0 WHEN high < {_Y} THEN CASE WHEN high >= {_Y - 1} THEN 14.0 WHEN high >= 3 THEN 8.0 ELSE 5.0 END WHEN low > {_Y} THEN CASE WHEN low - {_Y} <= 1 THEN 12.0 WHEN low - {_Y} <= 2 THEN 5.0 ELSE 0.0 END
    WHEN low < 2 THEN 12.0 ELSE 15.0 END AS points FROM t) SELECT CAST(points AS DOUBLE) AS points, count(*) AS n FROM p GROUP BY 1""",
)
def experience(spark, sf_dir):
    t = V.read(spark, sf_dir, "lineitem").select(F.expr(f"CASE WHEN l_linenumber = 7 THEN NULL ELSE {_LOW} END").alias("low"), F.expr(_HIGH).alias("high"))
    return t.groupBy(relevance.experience_points(c("low"), c("high")).alias("points")).agg(F.count("*").alias("n"))


@query("scl28_totals", "SELECT page_id, list_max(list_transform(regexp_extract_all(html, '(?i)(\\d[\\d,]*)\\s+(?:open\\s+)?(?:jobs|positions|openings|results)', 1), lambda x: CAST(replace(x, ',', '') AS BIGINT))) AS total FROM pages")
def page_totals(spark, sf_dir):
    return V.pages(spark, sf_dir).select("page_id", T.largest_total(c("html")).alias("total"))


@query("scl34_wrapped_code", "SELECT conv_id, turn, TRY_CAST(nullif(regexp_extract('HTTP ' || (400 + conv_id % 30) || ' on ' || role, '\\b(401|403|404|410|429)\\b', 1), '') AS INTEGER) AS code FROM conversations")
def wrapped_code(spark, sf_dir):
    text = F.concat(F.lit("HTTP "), (400 + c("conv_id") % 30).cast("string"), F.lit(" on "), "role")
    return V.read(spark, sf_dir, "conversations").select("conv_id", "turn", T.wrapped_http_code(text).alias("code"))
