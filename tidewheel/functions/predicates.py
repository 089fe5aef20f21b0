"""Predicates over columns: the quality gate's rules, searches and page markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewheel.functions import profile as P
from tidewheel.functions.text import blank, either, strip, url_host, url_path, url_query


def valid_url(url: Column) -> Column:
    return F.coalesce(url.rlike("^https?://[^/?#]+"), F.lit(False))


def role_like(title: Column) -> Column:
    return blank(title).rlike(rf"(?i)\b(?:{'|'.join(P.ROLE_NOUNS)})\b")


def strong_detail_url(url: Column) -> Column:
    """A URL of one vacancy: a marker segment with a tail of its own, two branded forms, or a requisition key."""
    path = F.lower(F.regexp_replace(F.regexp_replace(url_path(url), "/+", "/"), "/$", ""))
    markers, tails = "|".join(P.DETAIL_MARKERS), "|".join(P.LISTING_TAILS)
    keys = rf"(?i)(?:^|&)(?:{'|'.join(P.JOB_QUERY_KEYS)})(?:=|&|$)"
    fragment = F.regexp_extract(url, "#(.*)", 1)
    found = path.rlike(rf"/(?:{markers})/(?!(?:{tails})(?:/|$))[^/]+") | path.rlike("/careers?/details?/[^/]+$") | path.rlike("/careerhub/explore/jobs/[^/]+$")
    return valid_url(url) & (found | url_query(url).rlike(keys) | fragment.rlike(keys))


def navigation_like(title: Column) -> Column:
    low = F.regexp_replace(F.regexp_replace(strip(F.lower(blank(title))), r"\s+", " "), "^[ :–—-]+|[ :–—-]+$", "")
    named = low.isin(*P.ACTION_ONLY, *P.NAVIGATION) | either(low.startswith(s) for s in P.NAVIGATION_STARTS)
    return (low == "") | named | (~role_like(title) & blank(title).rlike(P.NAVIGATION_PATTERN))


#: Fixed value: source types whose titles must look like a role.
HTMLISH = r"(?:^|_)(?:generic|browser|recovery_browser|official)_?html$|_html$"


def plausible(title: Column, source_type: Column, url: Column) -> Column:
    t, kind = strip(blank(title)), F.lower(strip(blank(source_type)))
    bare = F.regexp_replace(F.lower(t), "^[ :–—-]+|[ :–—-]+$", "")
    return (
        F.when(t == "", False)
        .when(kind.isin(*P.AUTHORITATIVE), True)
        .when(bare.isin(*P.ACTION_ONLY), False)
        .when(strong_detail_url(strip(blank(url))), True)
        .when(navigation_like(t), False)
        .when(kind.rlike(HTMLISH), role_like(t))
        .otherwise(True)
    )


def title_excluded(title_normal: Column) -> Column:
    """The reason if a normalised title is excluded, else null."""
    out = F.when(F.lit(False), "")
    for pattern in P.TITLE_EXCLUSIONS:
        out = out.when(title_normal.contains(pattern), f"excluded_title:{pattern}")
    return out


def mentions_india(location: Column) -> Column:
    return F.coalesce(location.ilike("%india%"), F.lit(False))


# Markers on pages.
CHALLENGE = "captcha|verify you are human|access denied|unusual traffic|cf-chl-|cloudflare ray id"
EMPTY_BOARD = "no (current )?(job |role |position )?(openings|vacancies)|no open (roles|positions|jobs)|there are no jobs|no opportunities available"
ATS_HOSTS = [
    "greenhouse.io", "lever.co", "ashbyhq.com", "smartrecruiters.com", "myworkdayjobs.com", "oraclecloud.com", "eightfold.ai", "icims.com",
    "successfactors.com", "jobs2web.com", "phenompeople.com", "avature.net", "kula.ai", "zwayam.com", "trakstar.com", "openings.co",
]


def challenged(html: Column) -> Column:
    return F.substring(blank(html), 1, 15000).rlike(f"(?i){CHALLENGE}")


def empty_board(text: Column) -> Column:
    return F.substring(blank(text), 1, 50000).rlike(f"(?i){EMPTY_BOARD}")


def ats_host(url: Column) -> Column:
    host = blank(url_host(url))
    return either(host.contains(h) for h in ATS_HOSTS)


def successfactors_page(html: Column, url: Column) -> Column:
    head = F.lower(F.substring(blank(html), 1, 250000))
    return F.lower(blank(url)).contains("successfactors") | head.contains("successfactors") | head.contains("jobs2web")


def text_search(term: str, *cols: Column) -> Column:
    like = f"%{term.strip()}%"
    return either(F.coalesce(c.ilike(like), F.lit(False)) for c in cols)
