"""Boards and endpoints that landed pages and postings point to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.text import url_host, url_path
from tidewheel.operators import pages as P
from tidewheel.operators.inventory import first_by

#: Hosts of providers, parts of a path that are no identity there, and the form of a job site's path. Fixed values.
HOSTS = ["greenhouse.io", "lever.co", "ashbyhq.com", "smartrecruiters.com", "eightfold.ai", "avature.net", "successfactors.com", "jobs2web.com", "careers.kula.ai", "oraclecloud.com", "myworkdayjobs.com"]
SECTIONS = ["jobs", "careers", "job"]
LANGUAGES = ["en-us", "en-gb", "fr-fr", "de-de", "es", "en", "fr", "de"]
SITE_PATH = r"(?i)/hcmUI/CandidateExperience/([^/]+)/sites/([^/]+)(?:/|$)"

IDENTITY = "struct<provider:string,tenant:string,host:string,site:string,locale:string>"


def board(url: Column) -> Column:
    """struct(provider, tenant, host, site, locale) of a careers URL by its host and path, the first rule that finds an identity; else null.

    Providers that are read from their entry page have no tenant.
    """
    host = url_host(url)
    path = F.coalesce(url_path(url), F.lit(""))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    first = F.get(parts, 0)
    past = lambda names: F.get(F.filter(parts, lambda x: ~F.lower(x).isin(*names)), 0)
    bare = F.regexp_replace(host, ":.*", "")
    found = lambda i: F.nullif(F.regexp_extract(path, SITE_PATH, i), F.lit(""))
    customer = F.nullif(F.regexp_extract(host, r"^([^.]+)\.wd\d+\.myworkdayjobs\.com$", 1), F.lit(""))

    def made(provider: str, tenant: Column | None = None, site: Column | None = None, locale: Column | None = None) -> Column:
        null = F.lit(None).cast("string")
        of = lambda value: null if value is None else value
        return F.struct(F.lit(provider).alias("provider"), of(tenant).alias("tenant"), host.alias("host"), of(site).alias("site"), of(locale).alias("locale")).cast(IDENTITY)

    rules = [
        (host.contains("greenhouse.io") & first.isNotNull(), made("greenhouse", first)),
        (host.endswith(".lever.co") & first.isNotNull(), made("lever", first)),
        (host.contains("ashbyhq.com") & first.isNotNull(), made("ashby", first)),
        (host.contains("smartrecruiters.com") & past(SECTIONS).isNotNull(), made("smartrecruiters", past(SECTIONS))),
        (bare == "eightfold.ai", made("eightfold", F.lit("app"))),
        (bare.rlike(r"[^.]\.eightfold\.ai$"), made("eightfold", F.regexp_extract(bare, r"([^.]+)\.eightfold\.ai$", 1))),
        (host.endswith(".avature.net") | (host == "avature.net"), made("avature")),
        (host.contains("successfactors.com") | host.contains("jobs2web.com"), made("successfactors")),
        ((host == "careers.kula.ai") & first.isNotNull(), made("kula", first)),
        (host.contains("oraclecloud.com") & found(2).isNotNull(), made("oracle", None, found(2), found(1))),
        (customer.isNotNull() & past(LANGUAGES).isNotNull(), made("workday", customer, past(LANGUAGES))),
    ]
    out = F.lit(None).cast(IDENTITY)
    for holds, value in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), value).otherwise(out)
    return out


def boards_of(pages: DataFrame) -> DataFrame:
    """(page_id, place, target, provider, tenant, host, site, locale): the boards that a page's links and loose URLs lead to, each once, by first occurrence."""
    # inline works each link out once
    found = P.outlinks(pages, HOSTS).select("page_id", "place", "target", F.inline(F.array_compact(F.array(board(F.col("target"))))))
    key = ["page_id", "provider", F.coalesce("tenant", F.lit("")), "host", F.coalesce("site", F.lit(""))]
    return first_by(found, key, ["place"])


def endpoints(rows: DataFrame, most: int = 50) -> DataFrame:
    """(company_id, endpoints): the response URLs that a board's postings came from, in order, the first ``most``; boards without one have no row.

    ``raw`` is a posting's record as JSON. No more than ``most`` URLs of a board meet in one row.
    """
    url = F.nullif(F.get_json_object("raw", "$._source_response_url"), F.lit(""))
    each = rows.select("company_id", url.alias("url")).where("url is not null").distinct()
    kept = each.withColumn("_place", F.row_number().over(Window.partitionBy("company_id").orderBy("url"))).where(F.col("_place") <= most)
    return kept.groupBy("company_id").agg(F.array_sort(F.collect_list("url")).alias("endpoints"))
