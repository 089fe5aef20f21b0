"""Postings from landed web pages and nested JSON."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import profile as P
from tidewheel.functions.predicates import ATS_HOSTS
from tidewheel.functions.text import blank, clean_text, either, url_host, url_path
from tidewheel.operators.inventory import first_by

JOB_PATH = r"(?i)/(job|jobs|jobdetail|career|careers|position|positions|opening|openings|requisition|vacanc(?:y|ies))([/?#]|$)"
MODALITY = r"(?i)\b(remote|hybrid|onsite|on-site|india|bengaluru|bangalore|gurugram|gurgaon|pune|hyderabad|mumbai|chennai|noida|delhi)\b"
#: Script bodies above this many characters aren't parsed.
SCRIPT_CHARS = 12_000_000
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


#: Characters of texts whose rows a task holds at once.
SLICE_CHARS = 1 << 20


def in_slices(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], text: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``run`` over slices of the batches, of ``SLICE_CHARS`` of column ``text`` and one more row at most: what it makes goes on a slice at a time."""

    def sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            begin, chars = 0, 0
            for n, value in enumerate(pdf[text], 1):
                chars += len(value or "")
                if chars >= SLICE_CHARS or n == len(pdf):
                    yield from run(iter([pdf.iloc[begin:n]]))
                    begin, chars = n, 0

    return sliced


class _Anchors(HTMLParser):
    """Anchors with their text, the text of the element around them, and the headings of three elements around."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[dict] = [{"tag": "", "text": [], "heads": []}]
        self.found: list[dict] = []
        self.scripts: list[list] = []

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        node = {"tag": tag, "text": [], "heads": [], "at": dict(attrs)}
        if tag == "a" and node["at"].get("href"):
            self.found.append({"href": node["at"]["href"], "node": node, "around": self.stack[-1], "over": self.stack[-3:][::-1]})
        if tag == "script":
            self.scripts.append([node["at"].get("type") or "", node["at"].get("id") or "", ""])
        self.stack.append(node)

    def handle_endtag(self, tag):
        names = [n["tag"] for n in self.stack]
        if tag in names[1:]:
            while True:
                node = self.stack.pop()
                if node["tag"] in ("h1", "h2", "h3", "h4", "h5"):
                    for over in self.stack:
                        over["heads"].append((node["tag"], " ".join(" ".join(node["text"]).split())))
                if node["tag"] == tag:
                    break

    def handle_data(self, data):
        if self.stack[-1]["tag"] == "script":
            self.scripts[-1][2] += data
        elif data.strip() and self.stack[-1]["tag"] != "style":
            for node in self.stack:
                node["text"].append(data.strip())


def _parsed(html: str | None) -> _Anchors:
    parser = _Anchors()
    parser.feed(html or "")
    parser.close()
    return parser


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    joined = lambda parts: " ".join(" ".join(parts).split())
    for pdf in batches:
        out = []
        for page_id, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"], strict=True):
            for i, a in enumerate(_parsed(html).found):
                try:
                    target = urljoin(url or "", a["href"])
                except ValueError:
                    continue
                heads = [text for over in a["over"] for tag in ("h1", "h2", "h3", "h4", "h5") for text in [t for t_, t in over["heads"] if t_ == tag][:1]]
                out.append((page_id, i, a["href"], target, joined(a["node"]["text"]), joined(a["around"]["text"]), heads))
        yield pd.DataFrame(out, columns=["page_id", "ord", "href", "target", "label", "context", "headings"])


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, ord, href, target, label, context, headings) of every anchor with an href."""
    return pages.select("page_id", "url", "html").mapInPandas(in_slices(_anchor_rows, "html"), "page_id long, ord int, href string, target string, label string, context string, headings array<string>")


def _script_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = [(p, i, kind, sid, body) for p, html in zip(pdf["page_id"], pdf["html"], strict=True) for i, (kind, sid, body) in enumerate(_parsed(html).scripts)]
        yield pd.DataFrame(out, columns=["page_id", "ord", "type", "script_id", "body"])


def embedded_json(pages: DataFrame) -> DataFrame:
    """(page_id, ord, type, body) of script elements that hold JSON state."""
    rows = pages.select("page_id", "html").mapInPandas(in_slices(_script_rows, "html"), "page_id long, ord int, type string, script_id string, body string")
    state = F.lower("type").rlike("application/(ld[+])?json") | F.col("script_id").isin("__NEXT_DATA__", "__NUXT_DATA__")
    return rows.where(state & (F.length("body") <= SCRIPT_CHARS) & F.try_parse_json("body").isNotNull()).drop("script_id")


def hinted(title: Column) -> Column:
    return blank(title).rlike(f"(?i)({'|'.join(P.TITLE_HINTS)})")


def infer_location(context: Column, title: Column) -> Column:
    rest = F.regexp_replace(F.replace(context, title, F.lit(" ")), r"^[ |\-–—]+|[ |\-–—]+$", "")
    return F.when((context != title) & (F.length(rest) <= 120) & rest.rlike(MODALITY), clean_text(rest))


def harvest_links(pages: DataFrame) -> DataFrame:
    """Postings that a page's anchors name: (page_id, ord, external_id, title, location, job_url)."""
    a = anchors(pages).where(~F.col("href").rlike("^(mailto:|tel:|javascript:)"))
    named = F.get(F.filter(F.concat(F.array("label"), "headings"), lambda x: hinted(x) & (F.length(x) > 3) & (F.length(x) <= 180)), 0)
    a = a.withColumn("title", F.coalesce(named, F.col("label")))
    path, titled = url_path(F.col("target")), hinted(F.col("title"))
    bare = F.regexp_replace(F.lower("label"), "^[ :–—-]+|[ :–—-]+$", "")
    detail = either(F.lower("target").contains(x) for x in ("/job", "/position", "/requisition"))
    listing = F.lower(F.regexp_replace(path, "/+$", "")).isin("/jobs", "/careers", "/career", "/openings", "/positions")
    keep = ~(bare.isin(*P.GENERIC_LABELS) & ~titled & ~detail) & (path.rlike(JOB_PATH) | titled) & F.length("title").between(4, 180) & ~(listing & ~titled)
    first = first_by(a.where(keep), ["page_id", "target"], ["ord"])
    return first.select("page_id", "ord", F.col("target").alias("external_id"), "title", infer_location(F.col("context"), F.col("title")).alias("location"), F.col("target").alias("job_url"))


LISTING_LABELS = ["open positions", "open roles", "search jobs", "view jobs", "explore jobs", "all jobs", "job openings", "current openings", "find jobs", "browse jobs"]


def listing_links(pages: DataFrame, most: int = 3) -> DataFrame:
    """The best listing links of each page: (page_id, target, score, place)."""
    a = first_by(anchors(pages), ["page_id", "target"], ["ord"])
    host = blank(url_host(F.col("target")))
    score = F.when(either(F.lower("label").contains(x) for x in LISTING_LABELS), 5).otherwise(0)
    score = score + F.when(url_path(F.col("target")).rlike(r"(?i)/(jobs|openings|positions|search-results|job-search|requisitions)(/|$|\?)"), 3).otherwise(0)
    score = score + F.when(either(host.contains(h) for h in ATS_HOSTS), 10).otherwise(0)
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "target"))
    return a.withColumn("score", score).where("score > 0").select("page_id", "target", "score", place.alias("place")).where(F.col("place") <= most)


#: Per-site rules: host part, path pattern with the id as group 1, URL template. Fixed values.
SITE_RULES = [
    ("example.com", r"/([a-z]{2})/(?:\d+)", "https://jobs.example.com/{id}"),
    ("example.net", r"/([a-z]{2})/(?:\d+)", "https://jobs.example.net/{id}"),
    ("example.org", r"/([a-z]{2})/(?:\d+)", "https://jobs.example.org/{id}"),
]


def by_site_rules(rows: DataFrame, url: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rows with the id and canonical URL of the first site rule that fits; a rule list is small and folds into the plan."""
    host, path = blank(url_host(F.col(url))), url_path(F.col(url))
    site = F.lit(None).cast("string")
    ident, canonical = site, site
    for part, pattern, template in reversed(rules):
        fits = host.contains(part) & path.rlike(pattern)
        found = F.regexp_extract(path, pattern, 1)
        before, after = template.split("{id}")
        site, ident, canonical = F.when(fits, part).otherwise(site), F.when(fits, found).otherwise(ident), F.when(fits, F.concat(F.lit(before), found, F.lit(after))).otherwise(canonical)
    return rows.withColumns({"site": site, "site_id": ident, "canonical_url": canonical})


#: Aliases of nested JSON records, in order of preference. Fixed values.
ALIASES = {
    "title": ["title", "Title", "jobTitle", "job_title", "name", "positionTitle"],
    "job_url": ["jobUrl", "job_url", "url", "absolute_url", "hostedUrl", "externalPath", "JobUrl"],
    "external_id": ["id", "Id", "_id", "jobId", "jobID", "job_id", "requisitionId", "externalId", "ref", "positionId", "positionDisplayId", "atsJobId", "reqId"],
    "location": ["location", "locations", "locationName", "locationsText", "city", "PrimaryLocation", "locationCountry"],
    "description": ["description", "descriptionPlain", "jobDescription", "content", "ShortDescriptionStr", "ExternalResponsibilitiesStr"],
    "posted_at": ["postedAt", "posted_at", "datePosted", "publishedAt", "postedOn", "PostedDate"],
}
JOB_KEYS = [
    "location", "locations", "PrimaryLocation", "locationCountry", "jobUrl", "job_url", "url", "id", "Id", "jobId", "requisitionId",
    "positionId", "reqId", "externalPath", "description", "ShortDescriptionStr",
]


def _objects(value):
    if isinstance(value, dict):
        yield value
        value = list(value.values())
    if isinstance(value, list):
        for child in value:
            yield from _objects(child)


def _place(value) -> str | None:
    if isinstance(value, dict):
        inner = value.get("address") if isinstance(value.get("address"), dict) else value
        parts = [inner.get(k) for k in ("addressLocality", "addressRegion", "addressCountry")] + [inner.get(k) for k in ("name", "city", "region", "country")]
        return ", ".join(str(p) for p in parts if p and not isinstance(p, (dict, list))) or None
    if isinstance(value, list):
        return ", ".join(x for x in map(_place, value) if x) or None
    return str(value) if value not in (None, "") else None


def _json_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for key, body in zip(pdf["key"], pdf["body"], strict=True):
            try:
                root = json.loads(body) if body else None
            except ValueError:
                continue
            for i, obj in enumerate(_objects(root)):
                found = {f: next((obj[k] for k in names if obj.get(k) not in (None, "", [])), None) for f, names in ALIASES.items()}
                if isinstance(found["title"], str) and any(k in obj for k in JOB_KEYS):
                    plain = {f: None if v is None else v if isinstance(v, str) else json.dumps(v) if isinstance(v, (dict, list)) else str(v) for f, v in found.items()}
                    plain["location"] = _place(found["location"])
                    out.append((key, i, *(plain[f] for f in ALIASES)))
        yield pd.DataFrame(out, columns=["key", "ord", *ALIASES])


def harvest_json(payloads: DataFrame, key: str, body: str) -> DataFrame:
    """Postings from JSON of any depth, in document order: (key, ord, title, job_url, external_id, location, ...)."""
    rows = payloads.select(F.col(key).cast("string").alias("key"), F.col(body).alias("body")).mapInPandas(in_slices(_json_rows, "body"), "key string, ord long, " + ", ".join(f"{f} string" for f in ALIASES))
    text = F.when(F.col("description").contains("<"), F.regexp_replace("description", "<[^>]+>", " ")).otherwise(F.col("description"))
    clean = {c: clean_text(F.col(c)) for c in ("title", "external_id", "location", "posted_at")}
    return rows.where(hinted(F.col("title"))).withColumns({**clean, "description": clean_text(text)})
