"""SQL pieces for the oracle: the views of :mod:`tidewheel.plans.views` and the text rules, written for DuckDB."""

from __future__ import annotations

from tidewheel.functions import profile as P
from tidewheel.operators import location as L
from tidewheel.plans import views as V


def text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def pick(key: str, values) -> str:
    return f"({array(values)})[CAST({key} % {len(values)} AS INTEGER) + 1]"


POSTINGS = f"""postings AS (
  SELECT source AS company_id, CAST(doc_id AS VARCHAR) AS external_id, 'Company ' || source AS company_name,
    {pick("doc_id", V.SOURCES)} AS source_type, {pick("doc_id", V.TITLES)} AS title, {pick("doc_id", V.LOCATIONS)} AS location,
    {pick("doc_id", V.SNIPPETS)} || chr(10) || text AS description,
    CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 6 = 1 THEN 'https://jobs.example.com/careers?page=' || doc_id
         ELSE 'https://jobs.example.com/' || source || '/job/' || (doc_id % 400) END AS job_url,
    '2026-0' || (doc_id % 9 + 1) || '-1' || (doc_id % 10) AS posted_at, doc_id % 31 AS first_seen_day, doc_id % 10 != 0 AS active,
    {pick("doc_id", ["new", "changed", "unchanged", None])} AS last_change_type, doc_id AS ord
  FROM documents)"""
BOARDS = """boards AS (
  SELECT 'src' || s_suppkey AS company_id, s_name AS company_name, s_suppkey + 1 AS rank, s_acctbal >= 0 AS enabled, n_name AS country
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)"""
SNAPSHOTS = """snapshots AS (
  SELECT run, company_id, external_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS content FROM (
    SELECT CAST(ts AS DATE) AS run, 'src' || (user_id % 10) AS company_id,
           CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 50 AS VARCHAR) AS external_id, event_type, ts, event_id FROM events)
  GROUP BY ALL)"""
RESULTS = """results AS (
  SELECT 'src' || l_suppkey AS company_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS run, count(DISTINCT l_orderkey) AS jobs_found FROM lineitem GROUP BY ALL)"""
PAGE_LOG = """paged AS (
  SELECT board, external_id, pos // 10 AS page_no, total FROM (
    SELECT o_custkey % 10 AS board, o_orderkey AS external_id, row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderkey) - 1 AS pos,
           count(*) OVER (PARTITION BY o_custkey % 10) AS total FROM orders)
), page_log AS (
  SELECT board, page_no, CASE WHEN page_no % 23 = 7 THEN NULL ELSE external_id END AS external_id, total FROM paged WHERE page_no % 17 != 5
  UNION ALL SELECT board, page_no + 100000, external_id, total FROM paged WHERE page_no % 29 = 3)"""
PROBES = f"""probes AS (
  SELECT conv_id, turn, array_to_string((string_split(text, ' '))[1:3], ' ') AS title, ([200, 404, 403, 200, 500, 410, 200, 429, 302, 200])[CAST((conv_id + turn) % 10 AS INTEGER) + 1] AS status,
    {pick("(conv_id + turn)", ["text/html", "application/pdf", None])} AS content_type,
    CASE WHEN (conv_id + turn) % 4 = 0 THEN 'JobPosting ' || text WHEN (conv_id + turn) % 4 = 1 THEN reverse(text) ELSE text END AS body FROM conversations)"""


def norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(translate(lower(coalesce({x}, '')), '–—', '--'), '[^a-z0-9+#./ -]+', ' ', 'g'), ' +', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def content_hash(title: str = "title", location: str = "location", description: str = "description") -> str:
    return "sha256(" + " || chr(10) || ".join(strip(f"coalesce({c}, '')") for c in (title, location, description)) + ")"


def alias(x: str, word: str) -> str:
    if len(word) <= 4 and word.replace("+", "").isalnum():
        return f"regexp_matches({x}, '(^|[^a-z0-9]){word}([^a-z0-9]|$)')"
    return f"contains({x}, {text(word)})"


def any_of(x: str, words) -> str:
    return "(" + " OR ".join(alias(x, w) for w in words) + ")"


def has(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {text(w)})" for w in words) + ")"


def coarse_location(x: str = "location") -> str:
    n = norm(x)
    cases = " ".join(f"WHEN {has(n, words)} THEN {text(name)}" for words, name in P.COARSE_LOCATIONS)
    return f"CASE WHEN {n} = '' THEN 'Unknown' WHEN contains({n}, 'remote') AND contains({n}, 'india') THEN 'Remote, India' {cases} WHEN contains({n}, 'remote') THEN 'Remote' ELSE {strip(x)} END"


def plainly_foreign(x: str = "location") -> str:
    n = norm(x)
    return f"({n} != '' AND NOT contains({n}, 'india') AND NOT (contains({n}, 'remote') AND NOT {has(n, P.FOREIGN_REMOTE)}) AND {has(n, P.FOREIGN_PLAIN)})"


def dedup_title(x: str = "title") -> str:
    n = norm(x)
    for old, new in P.TITLE_REPLACEMENTS:
        n = f"replace({n}, {text(old)}, {text(new)})"
    return f"trim(regexp_replace({n}, ' +', ' ', 'g'))"


def heading(x: str, words) -> str:
    return has(norm(x), words)


def section(words) -> str:
    """Of the list ``lines``."""
    closes = f"regexp_matches(x, '^[A-Za-z][A-Za-z /&+-]{{2,55}}:?$') AND len(regexp_split_to_array(x, '\\s+')) <= 7 AND NOT {heading('x', words)}"
    at = f"coalesce(list_position(list_transform(lines, lambda x: {heading('x', words)}), true), 0)"
    stop = f"coalesce(list_position(list_transform(lines[{at} + 2 :], lambda x: {closes}), true), 0)"
    body = f"array_to_string(lines[{at} + 1 : {at} + CASE WHEN {stop} > 0 THEN {stop} ELSE len(lines) END], chr(10))"
    return f"CASE WHEN {at} > 0 THEN {strip(body)} ELSE '' END"


_SPAN = r"(?i)(^|[^0-9])(\d{1,2}(?:\.\d+)?)\s*(?:-|to)\s*(\d{1,2}(?:\.\d+)?)\s*(?:\+\s*)?(?:years?|yrs?)\b"
_SINGLE = r"(?i)(?:^|[^0-9])(\d{1,2}(?:\.\d+)?)\s*(?:\+|plus|or more|and above|minimum|min\.?)?\s*(?:years?|yrs?)\b"


def mentions(x: str) -> str:
    clean = f"translate({x}, '–—', '--')"
    pair = f"list_transform(list_zip(regexp_extract_all({clean}, '{_SPAN}', 2), regexp_extract_all({clean}, '{_SPAN}', 3)), lambda z: [CAST(z[1] AS DOUBLE), CAST(z[2] AS DOUBLE)])"
    ranges = f"list_transform({pair}, lambda z: struct_pack(low := least(z[1], z[2]), o := false, high := greatest(z[1], z[2])))"
    rest = f"regexp_replace({clean}, '{_SPAN}', '\\1 ; ', 'g')"
    singles = f"list_transform(regexp_extract_all({rest}, '{_SINGLE}', 1), lambda z: struct_pack(low := CAST(z AS DOUBLE), o := true, high := CAST(NULL AS DOUBLE)))"
    return f"list_sort(list_filter(list_concat({ranges}, {singles}), lambda r: r.low <= 25 AND (r.high IS NULL OR r.high <= 30)))[1]"


def skill_points(skills, cap: float) -> str:
    parts = []
    for _, aliases, w in skills:
        parts.append(f"CASE WHEN {any_of('nreq', aliases)} THEN {int(w * 1000)} WHEN {any_of('npref', aliases)} THEN {int(w * 550)} WHEN {any_of('nfull', aliases)} THEN {int(w * 850)} ELSE 0 END")
    n = f"({' + '.join(parts)})"  # thousandths; to hundredths, halves to even
    return f"least(CAST({cap} AS DOUBLE), ({n} // 10 + CASE WHEN {n} % 10 > 5 OR ({n} % 10 = 5 AND ({n} // 10) % 2 = 1) THEN 1 ELSE 0 END) / 100.0::DOUBLE)"


def points(most: float, *parts) -> str:
    return f"least({most}.0::DOUBLE, " + " + ".join(f"CASE WHEN {c} THEN {v}.0::DOUBLE ELSE 0 END" for c, v in parts) + ")"


def band(score: str, filtered: str) -> str:
    return f"CASE WHEN {filtered} THEN 'filtered' WHEN {score} >= {P.HIGH} THEN 'high' WHEN {score} >= {P.GOOD} THEN 'good' WHEN {score} >= {P.RELEVANT} THEN 'possible' WHEN {score} >= {P.LOW} THEN 'low' ELSE 'filtered' END"


def scoring() -> str:
    """Tables from ``postings`` to ``scored``."""
    s = {k: f"sig_{k}" for k in P.SIGNALS}
    backend, full = has("ntitle", ["backend", "back end", "platform", "server"]), has("ntitle", ["full stack", "fullstack", "full-stack"])
    software = has("ntitle", ["software engineer", "software developer", "sde", "member of technical staff", "mts"])
    script, served = f"({s['typescript']} OR {s['javascript']})", f"({full} OR {s['fullstack']} OR {s['rest_api']} OR {s['backend']})"
    families = [
        points(40, (s["java"], 10), (s["spring"], 10), (f"({s['backend']} OR {backend})", 8), (s["rest_api"], 4), (s["microservices"], 3), (s["distributed_systems"], 3), (s["sql"], 2), (f"({s['java']} AND {software} AND NOT {backend})", 2)),
        points(40, (s["java"], 10), (s["spring"], 10), (s["react"], 8), (script, 6), (served, 6)),
        points(40, (s["node"], 12), (s["typescript"], 10), (s["javascript"], 5), (s["react"], 5), (s["sql"], 2), (f"({s['backend']} OR {backend} OR {s['rest_api']})", 6)),
        points(40, (s["node"], 10), (s["typescript"], 8), (s["javascript"], 4), (s["react"], 8), (s["sql"], 2), (served, 8)),
        points(36, (software, 10), (s["java"], 10), (script, 7), (s["distributed_systems"], 5), (s["rest_api"], 4), (s["sql"], 4)),
    ]
    ranked = ", ".join(f"struct_pack(points := {f}, priority := {p}::DOUBLE, place := {-i}, family := {text(k)})" for i, (f, (k, _, p)) in enumerate(zip(families, P.ROLE_FAMILIES, strict=True)))
    y, reject = P.YEARS, P.REJECT_YEARS
    exp = f"""CASE WHEN low IS NULL THEN 18.0 WHEN low >= {reject} THEN 0.0 WHEN high IS NOT NULL AND low <= {y} AND high >= {y} THEN 20.0
      WHEN high IS NULL AND low BETWEEN 2 AND {y} THEN 20.0 WHEN high < {y} THEN CASE WHEN high >= {y - 1} THEN 14.0 WHEN high >= 3 THEN 8.0 ELSE 5.0 END
      WHEN low > {y} THEN CASE WHEN low - {y} <= 1 THEN 12.0 WHEN low - {y} <= 2 THEN 5.0 ELSE 0.0 END WHEN low < 2 THEN 12.0 ELSE 15.0 END"""
    excluded = " ".join(f"WHEN contains(ntitle, {text(p)}) THEN {text('excluded_title:' + p)}" for p in P.TITLE_EXCLUSIONS)
    signals = ", ".join(f"{any_of('nboth', words)} AS sig_{k}" for k, words in P.SIGNALS.items())
    return f"""split AS (
  SELECT *, list_transform(string_split(coalesce(description, ''), chr(10)), lambda x: {strip("x")}) AS lines FROM postings
), sections AS (
  SELECT *, {section(P.REQUIRED_HEADINGS)} AS required, {section(P.PREFERRED_HEADINGS)} AS preferred FROM split
), texts AS (
  SELECT *, {norm("title")} AS ntitle, {norm("required")} AS nreq, {norm("preferred")} AS npref, {norm("description")} AS nfull,
    {norm("coalesce(title, '') || chr(10) || coalesce(description, '')")} AS nboth,
    coalesce({mentions("required")}, {mentions("coalesce(description, '')")}, {mentions("preferred")}) AS e FROM sections
), signalled AS (
  SELECT *, e.low AS low, e.high AS high, {signals} FROM texts
), ranked AS (
  SELECT *, list_sort([{ranked}], 'DESC')[1] AS best, CAST({exp} AS DOUBLE) AS experience_score, {skill_points(P.PRIMARY_SKILLS, P.PRIMARY_CAP)} AS primary_skill_score,
    {skill_points(P.SUPPORTING_SKILLS, P.SUPPORTING_CAP)} AS supporting_score, {coarse_location()} AS normalized_location FROM signalled
), summed AS (
  SELECT *, best.points AS role_score, CASE WHEN best.points < 5 THEN 'other' ELSE best.family END AS role_family,
    least(100.0::DOUBLE, round(best.points + experience_score + primary_skill_score + supporting_score, 2)) AS relevance_score FROM ranked
), reasoned AS (
  SELECT *, CASE {excluded} WHEN {plainly_foreign()} THEN 'location_outside_target'
    WHEN low >= {reject} THEN 'requires_' || CASE WHEN low = floor(low) THEN CAST(CAST(low AS INTEGER) AS VARCHAR) ELSE CAST(low AS VARCHAR) END || '+_years'
    WHEN role_score < 10 AND primary_skill_score < 5 THEN 'insufficient_target_stack_signal' END AS reason FROM summed
), scored AS (
  SELECT * EXCLUDE (reason), reason IS NOT NULL AS hard_filtered, {band("relevance_score", "reason IS NOT NULL")} AS relevance_status,
    {band("relevance_score", "reason IS NOT NULL")} IN ('high', 'good', 'possible') AS is_relevant,
    coalesce(reason, CASE WHEN {band("relevance_score", "false")} = 'filtered' THEN 'relevance_score_below_threshold' END) AS filter_reason FROM reasoned)"""


def padded(x: str) -> str:
    return f"(' ' || trim(regexp_replace(replace(lower(coalesce({x}, '')), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) || ' ')"


def _place_rows(table: dict[str, list[str]]) -> str:
    return "(VALUES " + ", ".join(f"({text(f' {a} ')}, {text(n)}, {len(a)})" for a, n in L.spelled(table)) + ") AS t(a, n, k)"


def located() -> str:
    """Tables from ``postings`` to ``located``: (external_id, status, normalized, evidence) by text and description lines."""
    code = "(VALUES " + ", ".join(f"({text(c)}, {text(n)}, {i})" for i, (c, n) in enumerate(L.OFFICE_CODES.items())) + ") AS t(c, n, i)"
    foreign = "(VALUES " + ", ".join(f"({text(f' {n} ')}, {text(n)}, {i})" for i, n in enumerate(L.FOREIGN)) + ") AS t(a, n, i)"
    best = lambda table: f"(SELECT arg_max(n, struct_pack(k := k, n := n)) FROM {_place_rows(table)} WHERE contains(v.pad, a))"
    phrases = " OR ".join(f"regexp_matches(pad, '{p}')" for p in L.DESCRIPTION_PHRASES)
    return f"""lines AS (
  SELECT external_id, unnest(range(1, 121)) AS i, unnest((list_filter(list_transform(string_split(coalesce(description, ''), chr(10)), lambda x: {strip("x")}), lambda x: x != ''))[1:120]) AS line FROM postings
), values_ AS (
  SELECT external_id, 0 AS i, location AS val FROM postings
  UNION ALL SELECT external_id, i, {strip("regexp_replace(line, '^[^:\\-]*[:\\-]', '')")} FROM lines
  WHERE regexp_matches(line, '(?i)\\b(?:job\\s+|work\\s+|workplace\\s+|office\\s+|primary\\s+)?location\\s*[:\\-]')
), v AS (SELECT DISTINCT val, {padded("val")} AS pad, {strip("coalesce(val, '')")} AS bare FROM values_
), hits AS (
  SELECT *, contains(pad, ' india ') OR contains(pad, ' bharat ') OR upper(bare) IN ('IN', 'IND') OR regexp_full_match(bare, '(?i)(?:remote\\s*[-,/|:]\\s*(?:IN|IND)|(?:IN|IND)\\s*[-,/|:]\\s*remote)') AS india,
    {best(L.CITIES)} AS city, {best(L.REGIONS)} AS region, {best(L.LOCALITIES)} AS locality,
    (SELECT arg_min(n, i) FROM {code} WHERE regexp_matches(coalesce(v.val, ''), '(^|[^A-Z0-9])' || c || '([^A-Z0-9]|$)')) AS code,
    (SELECT arg_min(n, i) FROM {foreign} WHERE contains(v.pad, a)) AS named FROM v
), judged AS (
  SELECT val, india, CASE WHEN NOT india THEN named END AS abroad,
    CASE WHEN pad = '  ' THEN NULL WHEN india AND contains(pad, 'remote') THEN 'Remote' WHEN india THEN coalesce(city, region, 'India') ELSE coalesce(city, region, locality, code) END AS place,
    CASE WHEN pad = '  ' THEN NULL WHEN india THEN CASE WHEN contains(pad, 'remote') OR coalesce(city, region) IS NULL THEN 'country_name_or_code' WHEN city IS NOT NULL THEN 'country+city' ELSE 'country+region' END
         WHEN city IS NOT NULL THEN 'city' WHEN region IS NOT NULL THEN 'region' WHEN locality IS NOT NULL THEN 'tech_locality' WHEN code IS NOT NULL THEN 'office_code' END AS why FROM hits
), told AS (
  SELECT external_id, arg_min(place, i) AS place, 'description_location:' || arg_min(why, i) AS why FROM values_ JOIN judged USING (val) WHERE i > 0 AND abroad IS NULL AND place IS NOT NULL GROUP BY external_id
), joined AS (
  SELECT p.external_id, p.location, j.india, j.abroad, j.place, j.why, coalesce(t.place, CASE WHEN {phrases} THEN CASE WHEN contains(pad, 'remote') THEN 'Remote' ELSE 'India' END END) AS t_place, coalesce(t.why, 'description_strong_india') AS t_why
  FROM (SELECT *, {padded("description")} AS pad FROM postings) p LEFT JOIN judged j ON p.location IS NOT DISTINCT FROM j.val LEFT JOIN told t ON p.external_id = t.external_id
), located AS (
  SELECT external_id,
    CASE WHEN india THEN 'india' WHEN abroad IS NOT NULL THEN 'foreign' WHEN coalesce(place, t_place) IS NOT NULL THEN 'india' ELSE 'unknown' END AS status,
    CASE WHEN (india OR abroad IS NULL) AND coalesce(place, t_place) IS NOT NULL THEN CASE coalesce(place, t_place) WHEN 'Remote' THEN 'Remote, India' WHEN 'India' THEN 'India' ELSE coalesce(place, t_place) || ', India' END
         ELSE coalesce(nullif({strip("location")}, ''), 'Unknown') END AS normalized,
    CASE WHEN india THEN 'location:' || why WHEN abroad IS NOT NULL THEN 'location:' || abroad WHEN place IS NOT NULL THEN 'location:' || why WHEN t_place IS NOT NULL THEN t_why
         WHEN trim({padded("location")}) IN ('remote', 'anywhere', 'global', 'worldwide', 'multiple locations', 'various locations') THEN 'remote_or_global_without_country' ELSE 'no_positive_india_evidence' END AS evidence FROM joined)"""
