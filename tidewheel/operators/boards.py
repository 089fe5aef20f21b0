"""The dimension of boards: checks of its configuration, and the state each board is in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Source types that can be read, and the settings that some of them need.
SUPPORTED = [
    "auto", "greenhouse", "lever", "ashby", "smartrecruiters", "workday", "custom_api", "custom_html", "playwright", "oracle", "eightfold",
    "successfactors", "kula", "apple", "meta", "amazon", "avature", "manual", "atlassian", "phenom", "goldman", "trakstar",
]
REQUIRED = {
    "greenhouse": ["board_token"],
    "lever": ["site"],
    "ashby": ["board_name"],
    "smartrecruiters": ["company_identifier"],
    "workday": ["host", "tenant", "site"],
    "oracle": ["host", "site_number"],
    "custom_api": ["endpoint", "field_mapping"],
    "custom_html": ["selectors"],
    "playwright": ["selectors"],
}
_EMPTY = ['""', "0", "0.0", "false", "null", "{}", "[]"]


def _json(path: str) -> Column:
    """The JSON text of a member; null where there is none."""
    return F.to_json(F.try_variant_get("v", path, "variant"))


def _filled(path: str) -> Column:
    text = _json(path)
    return text.isNotNull() & ~text.isin(*_EMPTY)


def _again(key: Column, ord: str) -> Column:
    """Whether an earlier row has the same key; rows without one are no group."""
    alone = F.concat(F.lit("row\u0001"), F.col(ord).cast("string"))
    w = Window.partitionBy(F.coalesce(F.concat(F.lit("key\u0001"), key), alone)).orderBy(ord)
    return key.isNotNull() & (F.row_number().over(w) > 1)


def config_errors(companies: DataFrame) -> DataFrame:
    """What is wrong with each row of the configuration: (ord, place, company_id, error), ``place`` in the order of the rules.

    companies: ord, from 1, and body, the row as JSON. A body that isn't an object lacks everything. Of rows that
    share an id or a rank all but the first are wrong. The settings a source needs are asked for only where its type is known.
    """
    rows = companies.select("ord", F.try_parse_json("body").alias("v"))
    text = lambda path: F.try_variant_get("v", path, "string")
    kind = lambda path: F.schema_of_variant(F.try_variant_get("v", path, "variant"))
    named = rows.select(
        "ord",
        "v",
        F.when(_filled("$.id"), text("$.id")).alias("company_id"),
        F.when(kind("$.rank") == "BIGINT", F.try_variant_get("v", "$.rank", "bigint")).alias("_rank"),
        F.when(_json("$.career_url") == "null", "None").otherwise(text("$.career_url")).alias("_url"),
        F.when(kind("$.source").startswith("OBJECT"), text("$.source.type")).alias("_type"),
    )
    good = F.when(F.col("_rank") > 0, F.col("_rank"))
    named = named.withColumns({"_id_again": _again(F.col("company_id"), "ord"), "_rank_again": _again(good.cast("string"), "ord")})
    row = F.concat(F.lit("row "), F.col("ord").cast("string"))
    who = F.coalesce("company_id", row)
    given = lambda path: _json(path).isNotNull() & (_json(path) != "null")
    says = lambda subject, *rest: F.concat(subject, *(F.lit(x) if isinstance(x, str) else x for x in rest))
    rules = [F.when(~_filled(f"$.{k}"), says(row, f": missing {k}")) for k in ("id", "name", "career_url", "source")]
    rules += [
        F.when(F.col("_id_again"), F.concat(F.lit("duplicate id: "), "company_id")),
        F.when(_json("$.enabled").isNotNull() & ~_json("$.enabled").isin("true", "false"), says(who, ": enabled must be true/false")),
        F.when(given("$.rank") & ~F.coalesce(F.col("_rank") > 0, F.lit(False)), says(who, ": rank must be a positive integer")),
        F.when(F.col("_rank_again"), F.concat(F.lit("duplicate rank: "), F.col("_rank").cast("string"))),
        F.when((F.coalesce("_url", F.lit("")) != "") & ~F.col("_url").rlike("^https?://"), says(who, ": invalid career_url")),
        F.when(~F.coalesce(F.col("_type").isin(*SUPPORTED), F.lit(False)), says(who, ": unsupported source type ", F.coalesce(F.concat(F.lit("'"), "_type", F.lit("'")), F.lit("None")))),
    ]
    for type_, keys in REQUIRED.items():
        rules += [F.when((F.col("_type") == type_) & ~_filled(f"$.source.{k}"), says(who, f": source {type_} requires {k}")) for k in keys]
    found = named.select("ord", "company_id", F.posexplode(F.array(*rules)).alias("place", "error"))
    return found.where("error is not null").select("ord", "place", "company_id", "error")


def latest_results(results: DataFrame, run_type: str) -> DataFrame:
    """(company_id, result): each board's result in its newest run of a type, by (created_at, run_id)."""
    rows = results.where(F.col("run_type") == run_type)
    return rows.groupBy("company_id").agg(F.max_by(F.struct("*"), F.struct("created_at", "run_id")).alias("result"))


def company_state(companies: DataFrame, postings: DataFrame, results: DataFrame) -> DataFrame:
    """Every board with its state: ``resolved_health``, the newest results of both kinds of run, and its postings.

    companies: company_id, enabled (null: yes) and more; postings: company_id,
    active; results: company_id, run_type (verify, fetch), run_id, created_at,
    status and more. A board that is off is ``disabled``, one without a verify run ``never_verified``.
    """
    counts = postings.groupBy("company_id").agg(F.count_if("active").alias("active_jobs"), F.count("*").alias("total_jobs"))
    of = lambda kind: latest_results(results, kind).withColumnRenamed("result", f"{'health' if kind == 'verify' else kind}_result")
    joined = companies.join(counts, "company_id", "left").join(of("verify"), "company_id", "left").join(of("fetch"), "company_id", "left")
    health = F.when(~F.coalesce("enabled", F.lit(True)), "disabled").when(F.col("health_result").isNotNull(), F.col("health_result.status")).otherwise("never_verified")
    none = F.lit(0).cast("long")
    return joined.withColumns({"resolved_health": health, "active_jobs": F.coalesce("active_jobs", none), "total_jobs": F.coalesce("total_jobs", none)})
