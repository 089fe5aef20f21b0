"""Text functions over columns: normal forms, hashes, identity keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewheel.functions import profile as P


def either(conditions: Iterable[Column]) -> Column:
    found = F.lit(False)
    for c in conditions:
        found = found | c
    return found


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """White space runs as one space; empty as null."""
    return F.nullif(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def low_words(c: Column, others: str = "") -> Column:
    """Lower case, with runs of anything but a-z, 0-9 and ``others`` as one space.

    Single spaces aren't matched at all, and case is changed when only ASCII is left, as it is slow beyond it; two
    characters beyond it have ASCII letters as lower case.
    """
    kept = rf"\p{{Alnum}}{others}"  # of ASCII, one look-up a character
    ascii_ = F.replace(F.replace(c, F.lit("\u212a"), F.lit("k")), F.lit("\u0130"), F.lit("i "))
    return F.lower(F.regexp_replace(ascii_, f"[^ {kept}][^{kept}]*| [^{kept}]+", " "))


def plain_dashes(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("–"), F.lit("-")), F.lit("—"), F.lit("-"))


def normalize_text(c: Column) -> Column:
    return F.trim(low_words(plain_dashes(blank(c)), "+#./-"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def stable_id(external_id: Column, company_id: Column, title: Column, location: Column, url: Column) -> Column:
    payload = F.concat_ws("|", *(blank(c) for c in (company_id, title, location, url)))
    return F.coalesce(F.nullif(external_id, F.lit("")), F.sha2(payload, 256))


def content_hash(title: Column, location: Column, description: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *(strip(blank(c)) for c in (title, location, description))), 256)


def analysis_hash(content: Column, ruleset: str = P.RULESET) -> Column:
    return F.sha2(F.concat(F.lit(f"{ruleset}:"), content), 256)


def coarse_location(location: Column, normal: Column | None = None) -> Column:
    """normal: the normalised location, where it is at hand as a column."""
    raw = normalize_text(location) if normal is None else normal
    out = F.when(raw == "", "Unknown").when(raw.contains("remote") & raw.contains("india"), "Remote, India")
    for needles, name in P.COARSE_LOCATIONS:
        out = out.when(either(raw.contains(n) for n in needles), name)
    return out.when(raw.contains("remote"), "Remote").otherwise(strip(location))


def plainly_foreign(text: Column) -> Column:
    """A foreign name as a mere substring of a normalised location, as the first scoring step has it."""
    named = either(text.contains(n) for n in P.FOREIGN_PLAIN)
    vague_remote = text.contains("remote") & ~either(text.contains(n) for n in P.FOREIGN_REMOTE)
    return (text != "") & ~text.contains("india") & ~vague_remote & named


def dedup_title(title: Column) -> Column:
    t = normalize_text(title)
    for old, new in P.TITLE_REPLACEMENTS:
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(t, " +", " "))


def near_block(company_id: Column, title: Column, location: Column) -> Column:
    return F.concat_ws("|", company_id, dedup_title(title), F.lower(coarse_location(location)))


def contains_alias(text: Column, alias: str) -> Column:
    """Short words need boundaries, longer ones may stand inside words. text is normalised."""
    if len(alias) <= 4 and alias.replace("+", "").isalnum():
        return text.contains(alias) & text.rlike(f"(?<![a-z0-9]){alias.replace('+', '[+]')}(?![a-z0-9])")
    return text.contains(alias)


def has_any(text: Column, aliases: Iterable[str]) -> Column:
    return either(contains_alias(text, a) for a in aliases)


def strip_tags(html: Column) -> Column:
    """HTML as text: tags become spaces, the five named entities their characters."""
    text = F.regexp_replace(html, "<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return clean_text(text)


def numeric_id(value: Column, digits: int = 8) -> Column:
    return F.nullif(F.regexp_extract(value, rf"(\d{{{digits},}})", 1), F.lit(""))


def url_host(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def set_query_parameter(url: Column, name: str, value: Column) -> Column:
    """url with one query parameter replaced or added, the others kept."""
    bare = F.regexp_replace(F.regexp_replace(url, rf"([?&]){name}=[^&#]*&?", "$1"), r"[?&](?=#|$)", "")
    joint = F.when(F.regexp_replace(bare, "#.*", "").contains("?"), "&").otherwise("?")
    pair = F.concat(joint, F.lit(f"{name}="), value.cast("string"))
    return F.concat(F.regexp_replace(bare, "#.*", ""), pair, F.regexp_extract(bare, "(#.*)", 1))


def first_filled(*cols: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))


def epoch_iso(seconds: Column) -> Column:
    n = F.expr("try_cast(x as double)") if seconds is None else seconds.try_cast("double")
    return F.when(n > 0, F.date_format(F.timestamp_seconds(n), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))


def change_pct(now: Column, previous: Column) -> Column:
    return F.when(previous > 0, F.round((now - previous) / previous * 100, 2))


_ERRORS = [  # fixed values, in order
    (["nameresolutionerror", "name or service not known", "temporary failure in name resolution", "failed to resolve"], "network_dns"),
    (["timeout", "timed out"], "network_timeout"),
    (["401", "authentication required"], "authentication_required"),
    (["403", "access denied"], "http_403_or_waf"),
    (["429"], "rate_limited"),
    (["captcha", "anti_bot", "verify you are human", "bot challenge"], "anti_bot_or_captcha"),
    (["automation_disallowed_or_unavailable"], "manual_or_approved_feed_required"),
    (["browser_fallback_disabled"], "needs_browser_or_provider_adapter"),
    (["no_jobs_detected"], "unsupported_or_empty_layout"),
]


def error_category(message: Column) -> Column:
    low = F.lower(blank(message))
    out = F.when(F.lit(False), "")
    for needles, name in _ERRORS:
        out = out.when(either(low.contains(n) for n in needles), name)
    return out.when(low.contains("playwright") & (low.contains("executable") | low.contains("browser")), "browser_runtime_missing").otherwise("fetch_or_parse_error")


def wrapped_http_code(message: Column) -> Column:
    return F.nullif(F.regexp_extract(message, r"\b(401|403|404|410|429)\b", 1), F.lit("")).cast("int")


def title_evidence(title: Column, body: Column) -> Column:
    """The title as a phrase, or enough of its longer words, stand in the body."""
    plain = lambda c: F.regexp_replace(F.lower(blank(c)), "[^a-z0-9]+", " ")
    t, b = F.trim(plain(title)), plain(body)
    tokens = F.filter(F.split(t, " "), lambda x: (F.length(x) >= 4) & ~x.isin("senior", "junior", "staff", "lead"))
    found = F.size(F.filter(tokens, lambda x: F.contains(b, x)))
    return (t != "") & (F.contains(b, t) | ((F.size(tokens) > 0) & (found >= F.least(F.lit(2), F.size(tokens)))))


def largest_total(text: Column) -> Column:
    """The largest number of jobs a page advertises."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)(\d[\d,]*)\s+(?:open\s+)?(?:jobs|positions|openings|results)"), 1)
    return F.array_max(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("long")))


def canonical_job_url(base: Column, job_id: Column) -> Column:
    """The public page of a job whose row has an id and no link, for the four host families that have one; else null."""
    host, path = url_host(base), url_path(base)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1)
    origin = F.concat(scheme, F.lit("://"), F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    site, cloud = r"(?i)/([^/]+)/sites/([^/]+)(?:/|$)", r"(?i)/hcmUI/CandidateExperience/([^/]+)/sites/([^/]+)(?:/|$)"
    part = lambda pattern, g, default: F.coalesce(F.nullif(F.regexp_extract(path, pattern, g), F.lit("")), F.lit(default))
    job = F.concat(F.lit("/job/"), job_id)
    return F.when(
        blank(job_id) != "",
        F.when(host == "careers.oracle.com", F.concat(origin, F.lit("/"), part(site, 1, "en"), F.lit("/sites/"), part(site, 2, "jobsearch"), job))
        .when(host.contains("oraclecloud.com") & path.rlike(cloud), F.concat(origin, F.lit("/hcmUI/CandidateExperience/"), part(cloud, 1, ""), F.lit("/sites/"), part(cloud, 2, ""), job))
        .when(host.endswith(".eightfold.ai"), F.concat(origin, F.lit("/careers/job/"), job_id))
        .when(host == "careers.swiggy.com", F.concat(origin, F.lit("/#/careers?reqid="), job_id)),
    )


#: Where a detail page's path holds the job's id, in order.
JOB_PATHS = [r"/job/(\d+)(?:-|/|$)", r"/details/(\d+(?:-\d+)?)(?:/|$)", r"/careers/details/(\d+)(?:/|$)", r"/jobs/(\d+)(?:/|$)", r"/opportunity/([^/]+)$"]


def job_id_from_url(url: Column) -> Column:
    """The id in the path, or the jobId of the query, or the URL itself."""
    path = F.regexp_replace(url_path(url), "/+$", "")
    found = [F.nullif(F.regexp_extract(path, f"(?i){p}", 1), F.lit("")) for p in JOB_PATHS]
    asked = F.nullif(F.regexp_extract(url_query(url), r"(?:^|&)(?:jobId|jobid)=([^&]+)", 1), F.lit(""))
    return F.coalesce(*found, asked, url)


def board_identity(url: Column) -> Column:
    """struct(provider, tenant) of a careers URL by its host and path; nulls where none is known."""
    host, path, query = url_host(url), url_path(url), url_query(url)
    first, sub = F.nullif(F.regexp_extract(path, "^/([^/]+)", 1), F.lit("")), F.regexp_extract(host, r"^([^.]+)\.", 1)
    asked = F.nullif(F.regexp_extract(query, "(?:^|&)for=([^&]+)", 1), F.lit(""))
    rules = [
        ("greenhouse", host.endswith("greenhouse.io"), F.coalesce(asked, F.when(first == "embed", None).otherwise(first))),
        ("lever", host.endswith("jobs.lever.co"), first),
        ("ashby", host == "jobs.ashbyhq.com", first),
        ("smartrecruiters", host.endswith("smartrecruiters.com"), first),
        ("workday", host.endswith("myworkdayjobs.com"), sub),
        ("eightfold", host.endswith(".eightfold.ai"), sub),
        ("oracle", host.contains("oraclecloud.com"), F.nullif(F.regexp_extract(path, r"(?i)/sites/([^/]+)", 1), F.lit(""))),
    ]
    provider = tenant = F.when(F.lit(False), "")
    for name, holds, value in rules:
        provider, tenant = provider.when(holds, name), tenant.when(holds, value)
    return F.struct(provider.alias("provider"), tenant.alias("tenant"))


#: Fixed value: what a closed posting's page says.
CLOSED = r"\b(job has been closed|job is no longer available|position has been filled|no longer accepting applications)\b"


def live_link(status: Column, body: Column) -> Column:
    """Whether a record that no posting matches counts as live: gone pages and those that say so don't, failed checks do."""
    return ~(F.coalesce(status.isin(404, 410), F.lit(False)) | (F.coalesce(status < 400, F.lit(False)) & blank(body).rlike(f"(?i){CLOSED}")))
