"""Exports and write-once artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators.runs import certification_summary, health_summary, keep_baseline

#: The columns of a relevance export, in order. Fixed values.
EXPORT = [
    "company_name", "title", "location", "normalized_location", "posted_at", "first_seen_at", "last_seen_at", "active", "change_type", "role_label", "min_experience", "max_experience",
    "role_score", "experience_score", "primary_skill_score", "supporting_score", "relevance_score", "relevance_status", "is_relevant", "matched_primary", "matched_supporting",
    "filter_reason", "job_url", "company_id", "external_id", "description",
]


def relevance_export(scored: DataFrame, path: str, kind: str, relevant_only: bool = False, min_score: float = 0) -> None:
    """The analysis as JSON or CSV files; skills are comma-joined names."""
    if kind not in ("json", "csv"):
        raise ValueError(f"unknown format {kind}")
    rows = scored.where(F.col("relevance_score") >= min_score)
    rows = rows.where("is_relevant") if relevant_only else rows
    skills = ("matched_primary", "matched_supporting")
    of = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), ", ").alias(c) if c in skills else F.col(c)
    out = rows.select(*(of(c) for c in EXPORT if c in scored.columns))
    (out.write.json if kind == "json" else out.write.option("header", True).csv)(path)


def artifacts(rows: DataFrame, run: str, columns: list[str]) -> DataFrame:
    """One row a run: its rows' digest, order aside, and their number; the payload itself is a partitioned dataset."""
    line = F.sha2(F.to_json(F.struct(*columns)), 256)
    return rows.groupBy(run).agg(F.count("*").alias("rows"), F.sum(F.conv(F.substring(line, 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("digest"))


def write_once(new: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """What to append: keys that aren't there yet. A key there with another digest is an error."""
    both = new.join(existing.select(*key, F.col("digest").alias("_old")), key, "left")
    checked = both.withColumn("digest", F.when(F.col("_old") != F.col("digest"), F.raise_error(F.lit("an artifact of this run exists with other content"))).otherwise(F.col("digest")))
    return checked.where(F.col("_old").isNull() | (F.col("digest") != F.col("_old"))).drop("_old")


#: The columns of a health table and of a certification table, in order. Fixed values.
HEALTH = [
    "rank", "id", "name", "status", "adapter", "configured_source", "jobs_found", "previous_jobs_found", "count_change_pct", "browser_used", "quality_ratio", "titles_valid", "urls_valid",
    "sample_detail_reachable", "sample_detail_status_code", "failure_category", "error", "career_url", "sample_job_url", "discovered_endpoints", "source_types", "duration_seconds",
]
CERTIFICATION = [
    "rank", "id", "name", "enabled", "verdict", "configured_source", "provider_hint", "adapter", "jobs_found", "unique_jobs", "expected_count", "completeness_pct", "raw_records", "rejected_non_job_records",
    "valid_url_ratio", "stable_id_ratio", "description_ratio", "location_ratio", "detail_verified", "failure_category", "error", "recommended_action", "duration_seconds",
]


def _flat(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns there are, in order, with lists as one text."""
    kinds = dict(rows.dtypes)
    return rows.select(*(F.array_join(c, " | ").alias(c) if kinds[c].startswith("array") else F.col(c) for c in columns if c in kinds))


def _dated(rows: DataFrame, path: str, parts: list[str]) -> None:
    """Rows by partition; a partition that is there already is replaced, the others stay."""
    rows.write.partitionBy(*parts).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def write_health(rows: DataFrame, root: str, generated_at: str) -> DataFrame:
    """A health report under ``root``: all reports by day and time, the newest as JSON and CSV, and the last good counts; returns the summary.

    rows: HEALTH columns, ``id`` and ``jobs_found`` and ``status`` at least. A report
    of the same time replaces its own partition only. Where the name service
    fails for most boards the last good counts stay as they were (``keep_baseline``).
    """
    spark = rows.sparkSession
    stamped = rows.withColumns({"generated_at": F.lit(generated_at), "day": F.lit(generated_at[:10])})
    _dated(stamped, f"{root}/history", ["day", "generated_at"])
    # what was written is read again, so that all parts of a report say the same
    written = spark.read.parquet(f"{root}/history").where((F.col("day").cast("string") == generated_at[:10]) & (F.col("generated_at").cast("string") == generated_at)).drop("day", "generated_at")
    order = [F.coalesce("rank", F.lit(10**9)), F.col("id")] if "rank" in rows.columns else [F.col("id")]
    written.orderBy(*order).write.mode("overwrite").json(f"{root}/latest/json")
    _flat(written, HEALTH).orderBy(*order).write.mode("overwrite").option("header", True).csv(f"{root}/latest/csv")
    summary = health_summary(written if "failure_category" in rows.columns else written.withColumn("failure_category", F.lit(None).cast("string")))
    blocked = bool(summary.first().environment_blocked)
    kept = keep_baseline(read_baseline(spark, root), written.select(F.col("id").alias("company_id"), "jobs_found", "status"), blocked)
    # each report's counts are a partition of their own, so the one that is read isn't the one that is written
    _dated(kept.withColumn("generated_at", F.lit(generated_at)), f"{root}/baseline", ["generated_at"])
    return summary


def read_baseline(spark: SparkSession, root: str) -> DataFrame:
    """(company_id, jobs_found): the last good counts of the newest report, none before the first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/baseline")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "company_id string, jobs_found long")
    rows = spark.read.schema("company_id string, jobs_found long, generated_at string").parquet(f"{root}/baseline")
    newest = rows.agg(F.max("generated_at").alias("generated_at"))
    return rows.join(newest, "generated_at").select("company_id", "jobs_found")


def write_certification(rows: DataFrame, root: str, generated_at: str) -> DataFrame:
    """A certification report as JSON, CSV and a Markdown table; returns the summary.

    rows: CERTIFICATION columns; boards stand by rank, then id.
    """
    ordered = rows.orderBy(F.coalesce("rank", F.lit(10**9)), F.coalesce("id", F.lit("")))
    ordered.write.mode("overwrite").json(f"{root}/json")
    _flat(ordered, CERTIFICATION).write.mode("overwrite").option("header", True).csv(f"{root}/csv")
    summary = certification_summary(rows)
    said = summary.first()
    shown = lambda c, other: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(other))
    cell = lambda c: F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("/"))
    rank = F.when(F.col("rank").isNull() | (F.col("rank") == 0), "-").otherwise(F.col("rank").cast("string"))
    complete = F.coalesce(F.concat(F.col("completeness_pct").cast("string"), F.lit("%")), F.lit("?"))
    line = F.format_string("| %s | %s | **%s** | %s | %s | %s | `%s` | %s |", rank, cell(F.coalesce(F.nullif("name", F.lit("")), "id")), shown("verdict", "-"), shown("jobs_found", "-"), shown("expected_count", "?"), complete, shown("adapter", "-"), cell(F.col("recommended_action")))
    head = ["# Company source certification", "", f"Generated: `{generated_at}`", "", f"Certified: **{said.certified}** / {said.companies} configured companies", "", "| # | Company | Verdict | Jobs | Expected | Complete | Adapter | Action |", "|---:|---|---|---:|---:|---:|---|---|"]
    top = rows.sparkSession.createDataFrame([(0, i, "", h) for i, h in enumerate(head)], "_part int, _rank long, _id string, value string")
    body = rows.select(F.lit(1).alias("_part"), F.coalesce(F.col("rank").cast("long"), F.lit(10**9)).alias("_rank"), F.coalesce("id", F.lit("")).alias("_id"), line.alias("value"))
    # one file, as it is one document with a line a board
    top.unionByName(body).orderBy("_part", "_rank", "_id").select("value").coalesce(1).write.mode("overwrite").text(f"{root}/markdown")
    return summary


def dated_copies(jobs: DataFrame, manifest: DataFrame, path: str) -> None:
    """Payloads and manifests of runs by year, month and ``date_run``; copying a run again replaces its own copy only.

    jobs, manifest: as ``Deliveries.jobs`` and ``manifest``, whose run_created_at gives the date.
    """
    day = F.substring("run_created_at", 1, 10)
    parts = manifest.select("run", F.substring(day, 1, 4).alias("year"), F.substring(day, 6, 2).alias("month"), F.concat_ws("_", day, "run").alias("copy"))
    for name, rows in (("ai_input", jobs), ("manifest", manifest)):
        _dated(rows.join(parts, "run"), f"{path}/{name}", ["year", "month", "copy"])


def export_inventory(rows: DataFrame, path: str) -> None:
    """The whole inventory as JSON lines."""
    rows.write.json(path)


def daily_scan(fetched: DataFrame, analysis: DataFrame, figures: DataFrame, path: str) -> list[str]:
    """A day's files (fetch results, relevant postings as CSV and JSON) and the lines of its summary.

    fetched: a row a board with ``status``; analysis: as for :func:`relevance_export`; figures: as ``search.relevance_stats``.
    """
    fetched.write.json(f"{path}/daily_fetch")
    for kind in ("csv", "json"):
        relevance_export(analysis, f"{path}/relevant_jobs_{kind}", kind)
    n = fetched.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "suspicious").alias("suspicious")).first()
    f = figures.first()
    named = [("High priority", "high"), ("Good relevance", "good"), ("Possible relevance", "possible"), ("Low priority", "low"), ("Filtered", "filtered")]
    lines = [("Companies attempted", n.n), ("Fetch failed/suspicious", f"{n.failed} / {n.suspicious}"), ("Active jobs", f.active_jobs), ("New / changed jobs", f.new_changed)]
    lines += [(label, f.statuses.get(status, 0)) for label, status in named] + [("Relevant jobs", f.relevant_jobs), ("Relevant NEW/CHANGED", f.relevant_new_changed)]
    return [f"{label + ':':<25}{value}" for label, value in lines]
