"""Board health, completeness verdicts and reconciliation of passes and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.predicates import plausible
from tidewheel.functions.text import blank, change_pct, title_evidence
from tidewheel.operators import gate


def health(found: Column, previous: Column, quality: Column, allow_zero: Column, detail_code: Column, browser: Column, error: Column, threshold: float = 0.8) -> Column:
    """struct(status, category), the first rule that holds."""
    made = lambda s, c=None: F.struct(F.lit(s).alias("status") if isinstance(s, str) else s.alias("status"), F.lit(c).cast("string").alias("category"))
    return (
        F.when(error.isNotNull(), F.struct(F.lit("failed").alias("status"), error.alias("category")))
        .when((found == 0) & ~allow_zero, made("failed", "zero_jobs_detected"))
        .when(found == 0, made("healthy"))
        .when(quality < 0.9, made("suspicious", "low_job_record_quality"))
        .when((previous > 0) & (found < previous * (1 - threshold)), made("suspicious", "large_job_count_drop"))
        .when(detail_code.isin(401, 403, 429), made("healthy_with_fallback", "sample_detail_access_restricted"))
        .when((detail_code < 200) | (detail_code >= 400), made("suspicious", "sample_job_detail_unreachable"))
        .otherwise(made(F.when(browser, "healthy_with_fallback").otherwise("healthy")))
    )


def run_health(results: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Each board's runs against the one before: previous, change_pct, status, category, complete."""
    w = Window.partitionBy("company_id").orderBy("run")
    r = results.withColumn("previous", F.lag("jobs_found").over(w))
    h = health(F.col("jobs_found"), F.col("previous"), F.lit(1.0), F.lit(False), F.lit(200), F.lit(False), F.lit(None).cast("string"), threshold)
    return r.select("*", change_pct(F.col("jobs_found"), F.col("previous")).alias("change_pct"), h["status"].alias("status"), h["category"].alias("category"))


def browser_used(rows: DataFrame, board: str = "company_id") -> DataFrame:
    """(board, browser): whether any posting of a board came through a browser, by its source type or by what its record says.

    ``raw``, where rows have it, is the record's JSON.
    """
    used = F.coalesce(F.col("source_type").startswith("browser_"), F.lit(False))
    if "raw" in rows.columns:
        for mark in ("_fetch_via_browser", "_source_response_url"):
            used = used | ~F.coalesce(F.get_json_object("raw", f"$.{mark}"), F.lit("")).isin("", "false", "0", "{}", "[]")
    return rows.groupBy(board).agg(F.bool_or(used).alias("browser"))


def last_good(results: DataFrame) -> DataFrame:
    """For each board the count of its latest good run."""
    good = results.where("jobs_found > 0 and status in ('healthy', 'healthy_with_fallback', 'suspicious')")
    return good.groupBy("company_id").agg(F.max_by("jobs_found", "run").alias("last_good"))


def detail_verdict(status: Column, content_type: Column, title: Column, body: Column) -> Column:
    textual = content_type.isNull() | content_type.rlike("(?i)text|html")
    shown = textual & (blank(body) != "")
    return (
        F.when(status.isin(401, 403, 429), "access_restricted")
        .when(status.isin(404, 410), "dead")
        .when((status < 200) | (status >= 400), "http_error")
        .when(~shown, "reachable_unconfirmed")
        .when(F.lower(body).contains("jobposting") | title_evidence(title, body), "verified")
        .otherwise("reachable_unconfirmed")
    )


def completeness_verdict(n: Column, unique: Column, expected: Column, url_ratio: Column, dead: Column, raw: Column) -> Column:
    invalid = ((n > 0) & (F.coalesce(url_ratio, F.lit(0.0)) < 0.95)) | (dead > 0)
    return (
        F.when((n == 0) & (expected == 0), "CERTIFIED")
        .when((n == 0) & (raw > 0), "INVALID")
        .when(n == 0, "EMPTY_UNVERIFIED")
        .when(invalid, "INVALID")
        .when(expected.isNull(), "UNVERIFIED")
        .when(unique < expected, "PARTIAL")
        .when(unique > expected, "INVALID")
        .otherwise("CERTIFIED")
    )


# Fixed values.
RECOMMENDATIONS = {
    "CERTIFIED": "none; keep the source under drift monitoring",
    "BLOCKED": "use a company-approved API/feed or manual import; do not bypass the restriction",
    "PARTIAL": "fix pagination/filtering until fetched unique jobs equals the provider-reported total",
    "INVALID": "replace heuristic extraction with a provider/company-specific adapter before trusting this source",
    "FAILED": "repair the provider route or create a dedicated adapter; preserve the last certified snapshot",
}
GENERIC_SOURCE = "identify the authoritative ATS/API and replace generic extraction with a source contract/dedicated adapter"
NO_PROBE = "add an independent completeness probe for this provider before marking it certified"


def recommendation(verdict: Column, source_type: Column, rejected: Column, adapter: Column | None = None) -> Column:
    """What to do about a board; generic are automatic sources, adapters so named and boards with rejected rows."""
    named = F.lit(False) if adapter is None else F.coalesce(adapter.contains("Auto") | adapter.contains("Recovery"), F.lit(False))
    generic = F.coalesce(source_type == "auto", F.lit(False)) | named | (F.coalesce(rejected, F.lit(0)) > 0)
    known = F.create_map(*(F.lit(x) for pair in RECOMMENDATIONS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, verdict), F.when(generic, GENERIC_SOURCE).otherwise(NO_PROBE))


#: Why a board can't be read that wants an agreement, not a repair. Fixed values.
BLOCKING = ["manual_or_approved_feed_required", "authentication_required", "anti_bot_or_captcha", "http_403_or_waf", "rate_limited"]


def certify(boards: DataFrame, outcomes: DataFrame, rows: DataFrame, probes: DataFrame, details: DataFrame) -> DataFrame:
    """The whole certification of every board, one row each.

    boards: company_id, enabled, source_type, reason; outcomes: company_id, adapter,
    category and error of a fetch that failed (both null for one that didn't); rows: what
    the fetches gave, raw, as for ``gate.gate``; probes: company_id, expected_count, status,
    evidence; details: company_id and status of checked pages. A board that is switched
    off is BLOCKED if it is read by hand, else DISABLED; one whose fetch failed is BLOCKED or
    FAILED by the error's category; the others are judged by their records (``completeness_verdict``).
    Boards without rows, probe or checks have none; an empty table of boards gives no row.
    """
    seen = rows.withColumn("_ok", F.coalesce(plausible(F.col("title"), F.col("source_type"), F.col("job_url")), F.lit(False)))
    raw = seen.groupBy("company_id").agg(F.count("*").alias("raw_records"), F.count_if(~F.col("_ok")).alias("rejected_non_job_records"))
    quality = gate.board_quality(gate.gate(rows)).select("company_id", F.col("n").alias("jobs_found"), "unique_jobs", F.col("duplicates").alias("duplicate_records"), "valid_url_ratio", "stable_id_ratio", "description_ratio", "location_ratio", "source_types")
    checked = details.groupBy("company_id").agg(F.count_if(F.col("status").isin("dead", "invalid_url")).alias("_dead"), F.count_if(F.col("status") == "verified").alias("detail_verified"))
    probed = probes.select("company_id", "expected_count", (F.col("status") == "verified").alias("_probed"), "evidence")
    held = boards.select("company_id", "enabled", F.col("source_type").alias("configured_source"), "reason").join(outcomes.select("company_id", "adapter", "category", F.col("error").alias("_error")), "company_id", "left")
    for more in (raw, quality, checked, probed):
        held = held.join(more, "company_id", "left")
    off, failed = ~F.coalesce("enabled", F.lit(True)), F.col("category").isNotNull()
    unread = off | failed
    counts = ["raw_records", "rejected_non_job_records", "jobs_found", "unique_jobs", "duplicate_records", "detail_verified", "_dead"]
    held = held.withColumns({c: F.when(unread, 0).otherwise(F.coalesce(c, F.lit(0))).cast("long") for c in counts})
    held = held.withColumns({c: F.when(~unread, F.col(c)) for c in ("expected_count", "valid_url_ratio", "stable_id_ratio", "description_ratio", "location_ratio", "source_types", "evidence")})
    n, unique, expected = F.col("jobs_found"), F.col("unique_jobs"), F.col("expected_count")
    # nothing where nothing is expected counts only if the provider's count was verified
    sure = F.when((n > 0) | F.coalesce(F.col("_probed"), F.lit(False)), expected)
    judged = completeness_verdict(n, unique, sure, F.col("valid_url_ratio"), F.col("_dead"), F.col("raw_records"))
    verdict = F.when(off, F.when(F.col("configured_source") == "manual", "BLOCKED").otherwise("DISABLED")).when(failed, F.when(F.col("category").isin(*BLOCKING), "BLOCKED").otherwise("FAILED")).otherwise(judged)
    held = held.withColumn("verdict", verdict)
    verdict = F.col("verdict")
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    partial = F.concat(F.lit("provider expected "), said("expected_count"), F.lit(" unique jobs but adapter returned "), said("unique_jobs"))
    invalid = F.concat(F.lit("invalid/dead URLs="), said("_dead"), F.lit("; valid_url_ratio="), said("valid_url_ratio"), F.lit("; rejected_non_job="), said("rejected_non_job_records"))
    open_ = verdict.isin("UNVERIFIED", "EMPTY_UNVERIFIED")
    done = F.when(~unread, F.when(expected > 0, F.round(unique / expected * 100, 2)).when((expected == 0) & (unique == 0), 100.0))
    return held.select(
        "company_id",
        "enabled",
        "configured_source",
        "verdict",
        F.when(~off, F.col("adapter")).alias("adapter"),
        "raw_records",
        "jobs_found",
        "unique_jobs",
        "expected_count",
        done.alias("completeness_pct"),
        "rejected_non_job_records",
        "duplicate_records",
        "valid_url_ratio",
        "stable_id_ratio",
        "description_ratio",
        "location_ratio",
        "detail_verified",
        "source_types",
        F.when(off, "manual_or_disabled").when(failed, F.col("category")).when(verdict == "PARTIAL", "incomplete_fetch").when(verdict == "INVALID", "invalid_job_records").when(open_, "completeness_unverified").alias("failure_category"),
        F.when(off, F.coalesce(F.nullif(F.trim("reason"), F.lit("")), F.lit("company is disabled in config"))).when(failed, F.col("_error")).when(verdict == "PARTIAL", partial).when(verdict == "INVALID", invalid).when(open_, F.col("evidence")).alias("error"),
        recommendation(verdict, F.col("configured_source"), F.col("rejected_non_job_records"), F.col("adapter")).alias("recommended_action"),
    )


def verdict_counts(rows: DataFrame) -> DataFrame:
    """(verdict, n) of certified boards."""
    return rows.groupBy("verdict").agg(F.count("*").alias("n"))


def stable_within(before: DataFrame, after: DataFrame, key: list[str], board: str, tolerance: int = 2) -> DataFrame:
    """(board, differing, stable): keys that one of two lists of a board lacks, and whether they are ``tolerance`` at most."""
    once = lambda df, name: df.select(board, *key).distinct().withColumn(name, F.lit(1))
    both = once(before, "_b").join(once(after, "_a"), [board, *(k for k in key if k != board)], "full_outer")
    return both.groupBy(board).agg(F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("differing")).withColumn("stable", F.col("differing") <= tolerance)


def over_cap(log: DataFrame, cap: int) -> DataFrame:
    """(board, violation, n) of a page log whose total is more than a provider hands out."""
    return log.groupBy("board").agg(F.max("total").alias("n")).where(F.col("n") > cap).select("board", F.lit("total_over_cap").alias("violation"), "n")


def audit_pages(log: DataFrame) -> DataFrame:
    """(board, violation, n) of a page log (board, page_no, external_id, total)."""
    page = log.groupBy("board", "page_no").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("external_id").cast("string"))), ","), 256).alias("print"), F.count("external_id").alias("ids"), F.count("*").alias("rows"), F.max("total").alias("total"))
    again = page.where("ids > 0").groupBy("board", "print").agg(F.count("*").alias("c")).where("c > 1")
    covered = log.groupBy("board").agg(F.countDistinct("external_id").alias("unique"), F.max("total").alias("total"))
    found = page.where("ids = 0").groupBy("board").agg(F.lit("blank_page").alias("violation"), F.count("*").alias("n"))
    found = found.unionByName(again.groupBy("board").agg(F.lit("repeated_page").alias("violation"), F.sum(F.col("c") - 1).alias("n")))
    found = found.unionByName(log.where("external_id is null").groupBy("board").agg(F.lit("row_without_id").alias("violation"), F.count("*").alias("n")))
    return found.unionByName(covered.where("unique < total").select("board", F.lit("not_covered").alias("violation"), (F.col("total") - F.col("unique")).alias("n")))


def pass_evidence(passes: DataFrame) -> DataFrame:
    """(company_id, run, unique_ids, added, missing) of passes (company_id, run, external_id) over a board: ids new in
    each pass, and ids of earlier passes that it lacks."""
    keys = passes.select("company_id", "run", "external_id").distinct()
    first = keys.groupBy("company_id", "external_id").agg(F.min("run").alias("run"))
    added = first.groupBy("company_id", "run").agg(F.count("*").alias("added"))
    counted = keys.groupBy("company_id", "run").agg(F.count("*").alias("unique_ids")).join(added, ["company_id", "run"], "left")
    so_far = F.sum(F.coalesce("added", F.lit(0))).over(Window.partitionBy("company_id").orderBy("run").rowsBetween(Window.unboundedPreceding, 0))
    return counted.select("company_id", "run", "unique_ids", F.coalesce("added", F.lit(0)).alias("added"), (so_far - F.col("unique_ids")).alias("missing"))


def merge_passes(rows: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """The union of passes: the longest text of each key, of equal ones the latest."""
    return rows.groupBy(*key).agg(F.max_by(value, F.struct(F.length(value), order)).alias(value), F.countDistinct(order).alias("passes"))


def window_verdict(before: DataFrame, produced: DataFrame, after: DataFrame, key: list[str], board: str) -> DataFrame:
    """Ids in both windows must be produced: (board, stable, missing, extra, verdict)."""
    mark = lambda df, name: df.select(*key).distinct().withColumn(name, F.lit(1))
    all_ = mark(before, "b").join(mark(produced, "p"), key, "full_outer").join(mark(after, "a"), key, "full_outer")
    stable = F.col("b").isNotNull() & F.col("a").isNotNull()
    out = all_.groupBy(board).agg(F.count_if(stable).alias("stable"), F.count_if(stable & F.col("p").isNull()).alias("missing"), F.count_if(F.col("p").isNotNull() & F.col("b").isNull() & F.col("a").isNull()).alias("extra"))
    return out.withColumn("verdict", F.when((F.col("missing") == 0) & (F.col("extra") == 0), "PASS").otherwise("FAIL"))


def window_marks(snapshots: DataFrame, board: str, id_col: str, run: str) -> DataFrame:
    """(board, run, id, before, produced, after): the ids of every three consecutive runs of a board, by the middle one,
    and in which of the three they stand. Rows without a run are in none."""
    rows = snapshots.where(F.col(run).isNotNull()).select(board, id_col, run).distinct()
    order = Window.partitionBy(board).orderBy(run)
    # one row a board and run; the first and last run of a board are the middle of nothing
    runs = rows.select(board, run).distinct().withColumns({"earlier": F.lag(run).over(order), "later": F.lead(run).over(order)})
    middles = runs.where("earlier is not null and later is not null").select(board, run)
    near = rows.join(runs, [board, run])
    place = lambda at, name: F.struct(at.alias("at"), *((F.lit(1) if x == name else F.lit(0)).alias(x) for x in ("before", "produced", "after")))
    spread = near.select(board, id_col, F.inline(F.array(place(F.col("later"), "before"), place(F.col(run), "produced"), place(F.col("earlier"), "after")))).withColumnRenamed("at", run)
    marks = spread.groupBy(board, run, id_col).agg(*((F.max(x) == 1).alias(x) for x in ("before", "produced", "after")))
    return marks.join(middles, [board, run], "left_semi")


def window_verdicts(marks: DataFrame, board: str, run: str) -> DataFrame:
    """(board, run, stable, missing, extra, verdict) of window_marks: window_verdict for each window."""
    stable = F.col("before") & F.col("after")
    counts = {"stable": stable, "missing": stable & ~F.col("produced"), "extra": F.col("produced") & ~F.col("before") & ~F.col("after")}
    out = marks.groupBy(board, run).agg(*(F.count_if(when).alias(name) for name, when in counts.items()))
    return out.withColumn("verdict", F.when((F.col("missing") == 0) & (F.col("extra") == 0), "PASS").otherwise("FAIL"))
