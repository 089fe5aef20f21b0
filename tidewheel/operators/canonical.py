"""Ids and URLs of postings in the form of their site, by rules from a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.text import blank, clean_text, url_host, url_path
from tidewheel.operators.inventory import first_by

_RULE = "site string, link string, groups array<int>, tenant_group int, whole_url boolean, own_id string, id_first boolean, keep_all boolean, keep_urls boolean, drop_host string, template string, template_only_without boolean, link_host string, set_id boolean, default_base string"

#: Fixed values of seven sites. link: where the URL (its path, or the whole) has the id, one of ``groups``; own_id: what an
#: external id must look like to stand in; id_first: a row's own id goes before the link's; keep_all and keep_urls: whether
#: rows without an id stay, all or those with a URL; drop_host: hosts whose URLs aren't the board's, where that has one of its own;
#: template: the URL of an id, for all rows that have one or only where the URL holds none; link_host: the host whose links count;
#: set_id: whether the row's id follows.
SITES = [
    {"site": "phenom", "link": r"(?i)/us/en/job/([^/]+)/", "own_id": r"^[\s\S]{8,}$", "keep_urls": True, "drop_host": "phenompeople.com"},
    {"site": "goldman", "link": r"(?i)/roles/(\d+)(?:[/?#]|$)", "own_id": r"^\d+$", "template": "https://higher.gs.com/roles/{id}"},
    {"site": "atlassian", "link": r"(?i)/company/careers/details/(\d+)(?:[/?#]|$)", "own_id": r"^\d+$", "template": "https://www.atlassian.com/company/careers/details/{id}"},
    {"site": "trakstar", "link": r"(?i)/jobs/([a-z0-9_-]+)(?:[/?#]|$)"},
    {"site": "kula", "link": r"(?i)^/([^/]+)/(?:jobs/)?(\d+)(?:/(?:apply)?)?/?$", "groups": [2], "tenant_group": 1, "id_first": True, "keep_all": True, "template": "https://careers.kula.ai/{tenant}/{id}"},
    {"site": "avature", "link": r"(?i)/careers/JobDetail(?:/[^/?#]+)?/(\d+)(?:/|$)|[?&]jobId=(\d+)(?:&|$)", "groups": [1, 2], "whole_url": True, "own_id": r"^\d+$", "template": "{base}/{locale}/careers/JobDetail?jobId={id}", "template_only_without": True, "default_base": "https://careers.ibm.com"},
    {"site": "eightfold", "link": r"(?i)/careers/job/([0-9]+)", "link_host": ".eightfold.ai", "set_id": False, "keep_all": True, "template": "{base}/careers/job/{id}"},
]


def canonical_rules(spark: SparkSession, sites: list[dict] | None = None) -> DataFrame:
    """The rule table, a row a site."""
    usual = {"groups": [1], "whole_url": False, "id_first": False, "keep_all": False, "keep_urls": False, "template_only_without": False, "set_id": True}
    names = [c.split()[0] for c in _RULE.split(", ")]
    return spark.createDataFrame([tuple((usual | s).get(c) for c in names) for s in (SITES if sites is None else sites)], _RULE)


def _group(text: Column, pattern: Column, group: Column) -> Column:
    return F.nullif(F.call_function("regexp_extract", text, pattern, group), F.lit(""))


def canonicalize(rows: DataFrame, rules: DataFrame, boards: DataFrame | None = None) -> DataFrame:
    """Rows of (company_id, site, ord, external_id, title, location, job_url, ...) with ids and URLs as their site's rule says.

    The id is that of the URL, else the row's own if it looks like one; rows
    without either go, unless the rule keeps them. Then the first of each URL, title and place
    of a company stays. boards: company_id, tenant, base, locale, for rules
    that need them; where a tenant is known, a link must be its; a template whose
    base isn't known leaves the URL as it is. A row of a site without a rule stays, too.
    """
    held = rows.join(rules.select("site", F.struct("*").alias("_r")), "site", "left")
    if boards is not None:
        held = held.join(boards.select("company_id", F.struct(F.lower("tenant").alias("tenant"), "base", "locale").alias("_b")), "company_id", "left")
    else:
        held = held.withColumn("_b", F.lit(None).cast("struct<tenant:string,base:string,locale:string>"))
    r, b, url = F.col("_r"), F.col("_b"), F.col("job_url")
    text = F.when(r["whole_url"], url).otherwise(url_path(url))
    tenant = F.when(r["tenant_group"].isNotNull(), _group(text, r["link"], r["tenant_group"]))
    # a tenant other than the board's makes the link another's
    own = tenant.isNull() | b["tenant"].isNull() | (F.lower(tenant) == b["tenant"])
    own = own & (r["link_host"].isNull() | blank(url_host(url)).contains(r["link_host"]))
    found = F.when(own, F.get(F.filter(F.transform(r["groups"], lambda g: _group(text, r["link"], g)), lambda x: x.isNotNull()), 0))
    held = held.withColumns({"_found": found, "_tenant": tenant, "_eid": clean_text(F.col("external_id").cast("string"))})
    found, eid = F.col("_found"), F.col("_eid")
    fits = F.when(r["own_id"].isNotNull() & F.call_function("rlike", F.col("external_id"), r["own_id"]), F.col("external_id"))
    ident = F.when(r["id_first"], F.coalesce(eid, found)).otherwise(F.coalesce(found, fits))
    held = held.withColumn("_id", F.when(r["id_first"] & found.isNull(), F.lit(None)).otherwise(ident))
    ident = F.col("_id")
    part = lambda whole, name, value: F.replace(whole, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    base = F.regexp_replace(F.coalesce(b["base"], r["default_base"]), "/+$", "")
    made = part(part(part(part(r["template"], "id", F.coalesce(F.when(r["id_first"], found), ident)), "tenant", F.coalesce(b["tenant"], F.col("_tenant"))), "base", base), "locale", F.coalesce(b["locale"], F.lit("en_US")))
    # the board's own page, where there is one, goes before its provider's
    strange = r["drop_host"].isNotNull() & blank(url_host(url)).contains(r["drop_host"]) & (blank(b["base"]) != "")
    stays = r.isNull() | (ident.isNotNull() | r["keep_all"] | (r["keep_urls"] & (blank(url) != ""))) & ~F.coalesce(strange, F.lit(False))
    kept = held.where(stays).withColumns(
        {
            "external_id": F.coalesce(F.when(r["set_id"], ident), F.col("external_id").cast("string")),
            "job_url": F.when(ident.isNotNull() & r["template"].isNotNull() & (~r["template_only_without"] | found.isNull()) & (base.isNotNull() | ~r["template"].contains("{base}")), made).otherwise(url),
        }
    )
    return first_by(kept.select(*rows.columns), ["company_id", blank(F.col("job_url")), F.lower("title"), F.lower(blank(F.col("location")))], ["ord"])
