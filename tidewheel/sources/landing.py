"""Landed provider payloads as postings.

Each normaliser takes payloads (company_id, body), body being a JSON text, and
returns postings: company_id, source_type, ord, external_id, title, location,
description, job_url, posted_at. Bodies that aren't of the expected form give
no rows. ``ord`` numbers the rows of a payload, for first-wins dedupes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.text import blank, clean_text, epoch_iso, first_filled, strip_tags
from tidewheel.operators.gate import dedupe_extracted
from tidewheel.operators.pages import resolved

COLUMNS = ["company_id", "source_type", "ord", "external_id", "title", "location", "description", "job_url", "posted_at"]


def _rows(payloads: DataFrame, schema: str, path: str | None) -> DataFrame:
    """(company_id, ord, r): the records of each payload."""
    parsed = payloads.select("company_id", F.from_json("body", schema).alias("b"))
    records = F.col("b") if path is None else F.col(f"b.{path}")
    return parsed.select("company_id", F.posexplode(records).alias("ord", "r")).where("r is not null")


def _postings(rows: DataFrame, source: str, **columns: Column) -> DataFrame:
    null = F.lit(None).cast("string")
    out = rows.select("*", F.lit(source).alias("source_type"), *(columns.get(c, null).cast("string").alias(c) for c in COLUMNS[3:]))
    return out.where("title is not null and title != ''").select(*COLUMNS)


def greenhouse(payloads: DataFrame) -> DataFrame:
    r = _rows(payloads, "struct<jobs:array<struct<id:bigint,title:string,location:struct<name:string>,content:string,absolute_url:string,first_published:string,updated_at:string>>>", "jobs")
    unescaped = F.replace(F.replace(F.replace("r.content", F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return _postings(r, "greenhouse", external_id=F.col("r.id"), title=F.col("r.title"), location=F.col("r.location.name"), description=strip_tags(unescaped), job_url=F.col("r.absolute_url"), posted_at=first_filled(F.col("r.first_published"), F.col("r.updated_at")))


def lever(payloads: DataFrame) -> DataFrame:
    r = _rows(payloads, "array<struct<id:string,text:string,hostedUrl:string,createdAt:bigint,descriptionPlain:string,additionalPlain:string,categories:struct<location:string,allLocations:array<string>>>>", None)
    place = first_filled(F.col("r.categories.location"), F.array_join("r.categories.allLocations", ", "))
    text = F.concat_ws("\n\n", F.nullif("r.descriptionPlain", F.lit("")), F.nullif("r.additionalPlain", F.lit("")))
    return _postings(r, "lever", external_id=F.col("r.id"), title=F.col("r.text"), location=place, description=text, job_url=F.col("r.hostedUrl"), posted_at=F.col("r.createdAt"))


def ashby(payloads: DataFrame) -> DataFrame:
    r = _rows(payloads, "struct<jobs:array<struct<id:string,title:string,location:string,jobUrl:string,descriptionPlain:string,descriptionHtml:string,publishedAt:string>>>", "jobs")
    return _postings(r, "ashby", external_id=first_filled(F.col("r.id"), F.col("r.jobUrl")), title=F.col("r.title"), location=F.col("r.location"), description=first_filled(F.col("r.descriptionPlain"), F.col("r.descriptionHtml")), job_url=F.col("r.jobUrl"), posted_at=F.col("r.publishedAt"))


def smartrecruiters(payloads: DataFrame) -> DataFrame:
    r = _rows(payloads, "struct<content:array<struct<id:string,ref:string,name:string,releasedDate:string,location:struct<city:string,region:string,country:string>>>>", "content")
    place = F.concat_ws(", ", *(F.nullif(f"r.location.{c}", F.lit("")) for c in ("city", "region", "country")))
    return _postings(r, "smartrecruiters", external_id=first_filled(F.col("r.ref"), F.col("r.id")), title=F.col("r.name"), location=F.nullif(place, F.lit("")), job_url=F.col("r.ref"), posted_at=F.col("r.releasedDate"))


def workday(payloads: DataFrame, host: str, locale: str, site: str) -> DataFrame:
    r = _rows(payloads, "struct<jobPostings:array<struct<title:string,externalPath:string,bulletFields:array<string>,locationsText:string,postedOn:string>>>", "jobPostings")
    url = F.concat(F.lit(f"https://{host}/{locale}/{site}"), F.col("r.externalPath"))
    return _postings(r, "workday", external_id=first_filled(F.get("r.bulletFields", 0), url), title=F.col("r.title"), location=F.col("r.locationsText"), job_url=url, posted_at=F.col("r.postedOn"))


_REQUISITION = "struct<Id:string,Title:string,PrimaryLocation:string,PostedDate:string,ShortDescriptionStr:string,ExternalResponsibilitiesStr:string,ExternalQualificationsStr:string>"


def oracle_requisitions(payloads: DataFrame, host: str, locale: str, site: str) -> DataFrame:
    parsed = payloads.select("company_id", F.from_json("body", f"struct<requisitionList:array<{_REQUISITION}>,items:array<struct<requisitionList:array<{_REQUISITION}>>>>").alias("b"))
    empty = F.array().cast(f"array<{_REQUISITION}>")
    nested = F.flatten(F.transform("b.items", lambda i: F.coalesce(i["requisitionList"], empty)))
    r = parsed.select("company_id", F.posexplode(F.concat(F.coalesce("b.requisitionList", empty), F.coalesce(nested, empty))).alias("ord", "r"))
    text = F.concat_ws("\n\n", *(F.nullif(f"r.{c}", F.lit("")) for c in ("ShortDescriptionStr", "ExternalResponsibilitiesStr", "ExternalQualificationsStr")))
    url = F.concat(F.lit(f"https://{host}/hcmUI/CandidateExperience/{locale}/sites/{site}/job/"), F.col("r.Id"))
    return _postings(r, "oracle", external_id=F.col("r.Id"), title=F.col("r.Title"), location=F.col("r.PrimaryLocation"), description=text, job_url=url, posted_at=F.col("r.PostedDate"))


#: Where a position's text may stand, the first that is filled counts. Fixed values.
PCS_TEXTS = ["jobDescription", "description", "descriptionPlain", "content"]


def pcs_in_india(standardized: Column, locations: Column) -> Column:
    """Whether a standardised place is India, or any place names it."""
    coded = F.exists(standardized, lambda x: F.upper(F.trim(blank(x))).rlike("^(?:.*, )?IN$"))
    named = F.exists(locations, lambda x: F.lower(blank(x)).contains("india"))
    return F.coalesce(coded, F.lit(False)) | F.coalesce(named, F.lit(False))


def pcs_positions(payloads: DataFrame, origin: str, domain: str | None = None, india_only: bool = False) -> DataFrame:
    """Positions with their places in order, each once. A position without an id or a title is an error.

    The URL is the public one where that is absolute, else the position's path, or one made from its id, on ``origin``,
    with ``domain`` asked for where it is given.
    """
    record = f"struct<id:string,name:string,title:string,locations:array<string>,standardizedLocations:array<string>,publicUrl:string,positionUrl:string,postedTs:string,{','.join(f'{c}:string' for c in PCS_TEXTS)}>"
    r = _rows(payloads, f"struct<positions:array<{record}>>", "positions")
    if india_only:
        r = r.where(pcs_in_india(F.col("r.standardizedLocations"), F.col("r.locations")))
    trimmed = lambda x: F.nullif(F.trim(x), F.lit(""))
    ident, title = trimmed(F.col("r.id")), trimmed(first_filled(F.col("r.name"), F.col("r.title")))
    checked = F.when(ident.isNull() | title.isNull(), F.raise_error(F.lit("a position has no id or no title"))).otherwise(title)
    places = F.array_join(F.array_distinct(F.filter(F.transform("r.locations", lambda x: F.trim(blank(x))), lambda x: x != "")), " | ")
    path = F.when(F.trim("r.positionUrl").startswith("/"), F.trim("r.positionUrl")).otherwise(F.concat(F.lit("/careers/job/"), ident))
    asked = F.concat(F.lit("?domain="), F.url_encode(F.lit(domain)), F.lit("&hl=en")) if domain else F.lit("")
    site = F.regexp_extract(F.lit(origin), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0)
    public = F.when(F.trim("r.publicUrl").rlike("^https?://"), F.trim("r.publicUrl"))
    texts = [F.nullif(strip_tags(F.col(f"r.{c}")), F.lit("")) for c in PCS_TEXTS]
    return _postings(r, "eightfold_pcsx", external_id=ident, title=checked, location=F.nullif(places, F.lit("")), description=F.coalesce(*texts), job_url=F.coalesce(public, F.concat(site, path, asked)), posted_at=epoch_iso(F.col("r.postedTs")))


def grouped_map(payloads: DataFrame, detail_base: str = "https://www.cohesity.com/careers/open-positions/") -> DataFrame:
    """Records under department names, or as a plain list; first by requisition id, else opaque id, in document order.

    A department doesn't replace one of the record's own. Further places are appended where the first
    doesn't hold them; a record without a title or an id is passed over.
    """
    record = "struct<req_id:string,JobID:string,title:string,primaryLocation:string,AdditionalLocations:string,jobUrl:string,url:string,careerSiteDept:string>"
    none = F.lit(None).cast(f"array<{record}>")
    parsed = payloads.select("company_id", F.from_json("body", f"struct<job_data:map<string,array<{record}>>>")["job_data"].alias("groups"), F.from_json("body", f"struct<job_data:array<{record}>>")["job_data"].alias("listed"))
    groups, listed = F.col("groups"), F.col("listed")
    every = F.when(groups.isNotNull(), F.transform(F.map_entries(groups), lambda e: F.struct(e["key"].alias("department"), e["value"].alias("rows")))).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("department"), F.coalesce(listed, none).alias("rows"))))
    r = parsed.select("company_id", F.posexplode(every).alias("group", "g")).select("company_id", "group", "g.department", F.posexplode("g.rows").alias("place", "r"))
    r = r.withColumn("ord", F.col("group") * (1 << 20) + F.col("place"))
    cleaned = lambda c: F.nullif(clean_text(F.col(f"r.{c}")), F.lit(""))
    more, first = cleaned("AdditionalLocations"), cleaned("primaryLocation")
    places = F.when(more.isNotNull() & ~F.contains(F.coalesce(first, F.lit("")), more), F.concat_ws("; ", first, more)).otherwise(first)
    link = F.when(cleaned("JobID").isNotNull(), F.concat(F.lit(detail_base + "?gh_jid="), F.url_encode(cleaned("JobID")), F.lit("&type=wd"))).otherwise(first_filled(cleaned("jobUrl"), cleaned("url")))
    found = _postings(r, "cohesity_json", external_id=first_filled(cleaned("req_id"), cleaned("JobID")), title=cleaned("title"), location=places, description=first_filled(cleaned("careerSiteDept"), F.col("department")), job_url=link)
    return first_of(found.where("coalesce(title, '') != '' and coalesce(external_id, '') != ''"), F.asc("ord"))


def oracle_total(payloads: DataFrame) -> DataFrame:
    """(company_id, total): the greatest total that a payload's root or search wrappers declare."""
    parsed = payloads.select("company_id", F.from_json("body", "struct<TotalJobsCount:bigint,items:array<struct<TotalJobsCount:bigint>>>").alias("b"))
    return parsed.groupBy("company_id").agg(F.max(F.greatest("b.TotalJobsCount", F.array_max(F.transform("b.items", lambda i: i["TotalJobsCount"])))).alias("total"))


#: Words that place a posting in India, and states in which one is gone. Fixed values.
INDIA_HINT = r"(?i)\b(?:india|bengaluru|bangalore|hyderabad|gurugram|gurgaon|pune|chennai|noida|mumbai|delhi|new delhi)\b"
GONE = ["closed", "removed", "inactive", "expired"]


def india_openings(rows: DataFrame) -> DataFrame:
    """Open rows in India with a numeric id, their id and URL in the board's form.

    rows: ord, external_id, title, location, job_url and ``raw``, the record's JSON. The place may be in
    the row or in the record; the id is the first run of four digits or more between slashes among the row's id
    and six of the record's; a row without one stays only if its URL has one.
    """
    of = lambda c: F.get_json_object("raw", f"$.{c}")
    evidence = F.concat_ws(" ", "location", of("location"), of("locations"), of("city"), F.coalesce(of("country"), of("countryName")))
    state = F.lower(F.trim(F.coalesce(F.nullif(of("status"), F.lit("")), of("jobStatus"), F.lit(""))))
    number = lambda x: F.nullif(F.regexp_extract(x, r"(?:^|/)(\d{4,})(?:/|$)", 1), F.lit(""))
    ident = F.coalesce(number(F.col("external_id")), *(number(of(c)) for c in ("id", "jobId", "jobID", "positionId", "requisitionId", "reqId", "atsJobId")))
    named = F.coalesce(F.col("job_url").rlike(r"(?i)https://jobs\.uber\.com/en/jobs/\d+/?(?:$|[?#])"), F.lit(False))
    kept = rows.withColumn("_id", ident).where(F.coalesce(evidence.rlike(INDIA_HINT), F.lit(False)) & ~state.isin(*GONE) & (F.coalesce(of("isJobClosed"), F.lit("")) != "true") & (F.col("_id").isNotNull() | named))
    found = kept.withColumns({"external_id": F.coalesce("_id", "external_id"), "job_url": F.when(F.col("_id").isNotNull(), F.concat(F.lit("https://jobs.uber.com/en/jobs/"), "_id", F.lit("/"))).otherwise(F.col("job_url"))}).drop("_id")
    return dedupe_extracted(found)


def uber_positions(payloads: DataFrame) -> DataFrame:
    """Pages of search results; the last row of an id wins, by page and place. A row with an id but no title is an error."""
    record = "struct<Id:string,Title:string,Description:string,AdditionalText:string,Summary:string,DisplayDate:string,Locations:array<struct<Address:string,City:string,Region:string,Country:string>>>"
    parsed = payloads.select("company_id", F.from_json("body", f"struct<page:bigint,jobs:array<{record}>>").alias("b"))
    rows = parsed.select("company_id", F.coalesce("b.page", F.lit(1)).alias("page"), F.posexplode("b.jobs").alias("at", "r"))
    ident, title = clean_text(F.col("r.Id")), clean_text(F.col("r.Title"))
    rows = rows.where(F.coalesce(ident != "", F.lit(False))).withColumn("ord", F.row_number().over(Window.partitionBy("company_id", ident).orderBy(F.desc("page"), F.desc("at"))) - 1).where("ord = 0")
    checked = F.when(F.coalesce(title, F.lit("")) == "", F.raise_error(F.concat(F.lit("no title: "), ident))).otherwise(title)
    place = lambda x: first_filled(clean_text(x["Address"]), F.concat_ws(", ", *(F.nullif(clean_text(x[c]), F.lit("")) for c in ("City", "Region", "Country"))))
    places = F.array_join(F.array_distinct(F.filter(F.transform("r.Locations", place), lambda x: F.coalesce(x, F.lit("")) != "")), " | ")
    text = strip_tags(F.concat_ws("\n", *(F.nullif(F.trim(f"r.{c}"), F.lit("")) for c in ("Description", "AdditionalText", "Summary"))))
    return _postings(rows, "uber_jobs_api", external_id=ident, title=checked, location=F.nullif(places, F.lit("")), description=text, job_url=F.concat(F.lit("https://jobs.uber.com/en/jobs/"), ident, F.lit("/")), posted_at=clean_text(F.col("r.DisplayDate")))


def amazon_search(payloads: DataFrame) -> DataFrame:
    """Search rows. A place of the list is an object, the JSON text of one, or plain text."""
    fields = ["title", "job_path", "jobPath", "job_url", "url", "id_icims", "id", "job_id", "jobId", "location", "normalized_location", "description", "basic_qualifications", "preferred_qualifications", "posted_date", "postedDate", "updated_at"]
    r = _rows(payloads, f"struct<jobs:array<struct<{','.join(f'`{x}`:string' for x in fields)},locations:array<string>>>>", "jobs")
    of = lambda *names: first_filled(*(clean_text(F.col(f"r.{x}")) for x in names))
    path = of("job_path", "jobPath")
    url = F.when(F.coalesce(path, F.lit("")) == "", of("job_url", "url")).when(path.rlike("^https?://"), path).otherwise(F.concat(F.lit("https://www.amazon.jobs/"), F.ltrim(path, F.lit("/"))))
    in_path = F.nullif(F.regexp_extract(path, "(?i)/jobs/([^/?#]+)", 1), F.lit(""))
    part = lambda x, kind: first_filled(F.get_json_object(x, f"$.normalized{kind.title()}Name"), F.get_json_object(x, f"$.{kind}"))
    place = lambda x: F.when(F.ltrim(x).startswith("{") & F.try_parse_json(x).isNotNull(), F.concat_ws(", ", *(F.nullif(part(x, k), F.lit("")) for k in ("city", "state", "country")))).otherwise(clean_text(x))
    places = F.array_join(F.array_distinct(F.filter(F.transform("r.locations", place), lambda x: F.coalesce(x, F.lit("")) != "")), "; ")
    text = F.concat_ws("\n\n", *(F.nullif(clean_text(F.col(f"r.{x}")), F.lit("")) for x in ("description", "basic_qualifications", "preferred_qualifications")))
    return _postings(r, "amazon_json", external_id=first_filled(of("id_icims", "id", "job_id", "jobId"), in_path, url), title=of("title"), location=first_filled(of("location", "normalized_location"), F.nullif(places, F.lit(""))), description=F.nullif(text, F.lit("")), job_url=url, posted_at=of("posted_date", "postedDate", "updated_at"))


def first_of(postings: DataFrame, *order: Column) -> DataFrame:
    w = Window.partitionBy("company_id", "external_id").orderBy(*order, "title", "location")
    return postings.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def mapped(payloads: DataFrame, source: str, jobs_path: str, fields: dict[str, str]) -> DataFrame:
    """Dotted paths for the list and for each field of a record. A payload whose path isn't a list is an error.

    Where payloads have ``career_url``, relative URLs are resolved on it.
    """
    base = F.col("career_url") if "career_url" in payloads.columns else F.lit(None).cast("string")
    body = payloads.select("company_id", base.alias("career_url"), F.try_parse_json("body").alias("v")).where("v is not null")
    listed = body.select("company_id", "career_url", F.try_variant_get("v", f"$.{jobs_path}", "array<variant>").alias("rows"))
    checked = listed.withColumn("rows", F.when(F.col("rows").isNull(), F.raise_error(F.lit(f"{jobs_path} is not a list"))).otherwise(F.col("rows")))
    r = checked.select("company_id", "career_url", F.posexplode("rows").alias("ord", "r"))
    found = {name: clean_text(F.try_variant_get("r", f"$.{path}", "string")) for name, path in fields.items()}
    if "job_url" in found:
        found["job_url"] = F.when(F.col("career_url").isNull(), found["job_url"]).otherwise(resolved(F.col("career_url"), found["job_url"]))
    return _postings(r, source, **found)
