"""Runs and their deliveries: frozen scores, finalization, summaries and the states of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.inventory import KEY

FROZEN = ["normalized_location", "role_family", "min_experience", "max_experience", "relevance_score", "relevance_status", "is_relevant"]


def freeze(events: DataFrame, analysis: DataFrame) -> DataFrame:
    """The events of all runs with the scores their postings have now; null where a posting isn't analysed."""
    return events.join(analysis.select(*KEY, *FROZEN), KEY, "left")


def in_target(normalized_location: Column, country: str | None = "india") -> Column:
    """Whether a frozen location names the target country; everything does where none is set."""
    if not country:
        return F.lit(True)
    return F.lower(F.coalesce(normalized_location, F.lit(""))).contains(country.strip().lower())


def wanted(country: str | None = "india") -> Column:
    return F.coalesce(F.col("is_relevant"), F.lit(False)) & in_target(F.col("normalized_location"), country)


def finalize(frozen: DataFrame, versions: DataFrame, country: str | None = "india") -> DataFrame:
    """What a run hands on: its new and changed postings that are relevant and in the target country, by their versions
    (KEY, content, first_run). Frozen rows don't change, so doing it again gives the same."""
    chosen = frozen.where(F.col("event").isin("new", "changed") & wanted(country))
    return chosen.join(versions, [*KEY, "content"])


def summarize(frozen: DataFrame, country: str | None = "india") -> DataFrame:
    """A row for each run: postings observed, events by kind, and those handed on."""
    event, ok = F.col("event"), wanted(country)
    kinds = [F.count_if(event == k).alias(f"jobs_{k}") for k in ("new", "changed", "unchanged", "closed")]
    handed = [F.count_if((event == k) & ok).alias(f"{k}_relevant") for k in ("new", "changed")]
    return frozen.groupBy("run").agg(F.count_if("observed").alias("snapshot_jobs"), *kinds, *handed, F.count_if(event.isin("new", "changed") & ok).alias("ai_input_count"))


def with_current(frozen: DataFrame, versions: DataFrame, current: DataFrame) -> DataFrame:
    """Frozen rows by version, with ``raw`` of the current inventory where its content is still the same, else null."""
    return frozen.join(versions, [*KEY, "content"]).join(current.select(*KEY, "content", "raw"), [*KEY, "content"], "left")


def mark_duplicates(analysis: DataFrame, marks: DataFrame) -> DataFrame:
    """The analysis after marking; marks: KEY and the posting it copies (canonical_company_id, canonical_external_id)."""
    hit = F.col("canonical_company_id").isNotNull()
    to = lambda value, c: F.when(hit, value).otherwise(F.col(c))
    reason = F.concat(F.lit("near_duplicate:"), "canonical_company_id", F.lit("/"), "canonical_external_id")
    joined = analysis.join(marks, KEY, "left")
    changed = {"relevance_status": to(F.lit("duplicate"), "relevance_status"), "is_relevant": to(F.lit(False), "is_relevant"), "filter_reason": to(reason, "filter_reason")}
    return joined.withColumns(changed).withColumnsRenamed({"canonical_company_id": "duplicate_of_company_id", "canonical_external_id": "duplicate_of_external_id"})


def interrupt_stale(runs: DataFrame, at: Column | None = None) -> DataFrame:
    """Runs that were waiting or at work when the process ended; an error that is known stays. They end ``at`` that time, where it is given."""
    stale = F.col("status").isin("queued", "running")
    ended = {} if at is None else {"finished_at": F.when(stale, at).otherwise(F.col("finished_at"))}
    return runs.withColumns(ended | {"status": F.when(stale, "interrupted").otherwise(F.col("status")), "error": F.when(stale, F.coalesce("error", F.lit("Server restarted during run"))).otherwise(F.col("error"))})


def create(runs: DataFrame, asked: DataFrame) -> DataFrame:
    """Runs with those that are asked for: run_id, run_type, scope, created_at, total_companies, settings and targets.

    They are queued; a run that is known stays as it is. ``settings`` and ``targets`` are JSON texts, empty ones where null.
    """
    rows = asked.join(runs.select("run_id"), "run_id", "left_anti")
    queued = {"status": F.lit("queued"), "settings": F.coalesce("settings", F.lit("{}")), "targets": F.coalesce("targets", F.lit("[]"))}
    return runs.unionByName(rows.withColumns(queued), allowMissingColumns=True)


def start(runs: DataFrame, started: DataFrame) -> DataFrame:
    """Runs after some began; started: (run_id, started_at)."""
    begun = started.select("run_id", F.col("started_at").alias("_at"), F.lit(True).alias("_begun"))
    now = F.coalesce("_begun", F.lit(False))
    return runs.join(begun, "run_id", "left").withColumns({"status": F.when(now, "running").otherwise(F.col("status")), "started_at": F.when(now, F.col("_at")).otherwise(F.col("started_at"))}).drop("_at", "_begun")


def finish(runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Runs after some ended; outcomes: (run_id, error), null for success, and maybe finished_at."""
    timed = "finished_at" in outcomes.columns
    ended = outcomes.select("run_id", F.col("error").alias("_error"), F.lit(True).alias("_ended"), *([F.col("finished_at").alias("_at")] if timed else []))
    status = F.when(F.col("_ended"), F.when(F.coalesce("_error", F.lit("")) != "", "failed").otherwise("completed")).otherwise(F.col("status"))
    changed = {"status": status, "error": F.when(F.col("_ended"), F.col("_error")).otherwise(F.col("error"))}
    if timed:
        changed["finished_at"] = F.when(F.col("_ended"), F.col("_at")).otherwise(F.col("finished_at") if "finished_at" in runs.columns else F.lit(None))
    return runs.join(ended, "run_id", "left").withColumns(changed).drop("_error", "_ended", "_at")


def artifact_errors(summaries: DataFrame, errors: DataFrame) -> DataFrame:
    """Summaries with the errors of some runs' artifacts; errors: (run_id, artifact_error). A run without a summary gets a
    row of its own; all else of the others stays."""
    marked = errors.select("run_id", F.col("artifact_error").alias("_error"), F.lit(True).alias("_marked"))
    old = F.col("artifact_error") if "artifact_error" in summaries.columns else F.lit(None).cast("string")
    return summaries.join(marked, "run_id", "full_outer").withColumn("artifact_error", F.when(F.col("_marked"), F.col("_error")).otherwise(old)).drop("_error", "_marked")


#: The states of a result that a run counts, and the names of the counts. Fixed values.
ROLLED = {"healthy": "healthy", "healthy_with_fallback": "fallback", "suspicious": "suspicious", "failed": "failed"}


def rollup(results: DataFrame, run: str = "run_id") -> DataFrame:
    """A row for each run: results recorded (the last of a board, by created_at, counts), four states, and sums of jobs found, new and known ones.

    results: run, company_id, created_at, status, jobs_found, new_jobs, existing_jobs; null counts as none.
    """
    last = results.groupBy(run, "company_id").agg(F.max_by(F.struct("status", "jobs_found", "new_jobs", "existing_jobs"), "created_at").alias("r"))
    total = lambda c: F.sum(F.coalesce(F.col(f"r.{c}"), F.lit(0))).cast("long")
    states = [F.count_if(F.col("r.status") == k).alias(name) for k, name in ROLLED.items()]
    return last.groupBy(run).agg(F.count("*").alias("completed_companies"), *states, total("jobs_found").alias("jobs_found"), total("new_jobs").alias("jobs_new"), total("existing_jobs").alias("jobs_updated"))


def scan_summary(boards: DataFrame, stats: DataFrame) -> DataFrame:
    """One row after a scan: boards that failed or look suspicious (by ``health``), and all figures of the analysis (one row)."""
    counted = boards.agg(*(F.count_if(F.col("health") == k).alias(k) for k in ("failed", "suspicious")))
    one = F.lit(1).alias("_one")
    return counted.select("*", one).join(F.broadcast(stats.select("*", one)), "_one").drop("_one")  # one row each


def health_summary(rows: DataFrame) -> DataFrame:
    """One row over (status, jobs_found, failure_category): counts, jobs, and whether the name service fails so often
    that the fault lies in the environment."""
    dns = F.count_if(F.col("failure_category") == "network_dns")
    blocked = (F.count("*") > 0) & (dns >= F.greatest(F.lit(1), F.floor(F.count("*") * 0.8)))
    counts = [F.count_if(F.col("status") == k).alias(k) for k in ("healthy", "healthy_with_fallback", "suspicious", "failed")]
    return rows.agg(F.count("*").alias("verified"), *counts, F.coalesce(F.sum("jobs_found"), F.lit(0)).alias("total_jobs_detected"), dns.alias("network_dns"), blocked.alias("environment_blocked"))


def certification_summary(rows: DataFrame) -> DataFrame:
    """One row over (verdict, enabled, jobs_found)."""
    among = lambda *names: F.count_if(F.col("verdict").isin(*names))
    return rows.agg(
        F.count("*").alias("companies"),
        F.count_if("enabled").alias("attempted"),
        F.coalesce(F.sum("jobs_found"), F.lit(0)).alias("total_jobs_found"),
        among("CERTIFIED").alias("certified"),
        among("PARTIAL", "INVALID", "FAILED", "BLOCKED").alias("needs_attention"),
        among("UNVERIFIED", "EMPTY_UNVERIFIED").alias("needs_certification"),
    )


def keep_baseline(old: DataFrame, rows: DataFrame, blocked: bool) -> DataFrame:
    """(company_id, jobs_found): the last good count; rows: (company_id, jobs_found, status)."""
    if blocked:
        return old
    good = rows.where((F.col("jobs_found") > 0) & F.col("status").isin("healthy", "healthy_with_fallback", "suspicious"))
    return old.select("company_id", F.col("jobs_found").alias("_old")).join(good.select("company_id", "jobs_found"), "company_id", "full_outer").select("company_id", F.coalesce("jobs_found", "_old").alias("jobs_found"))
