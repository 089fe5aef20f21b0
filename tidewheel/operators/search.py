"""Searches with optional filters, and pages of them with totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.predicates import mentions_india, text_search

#: How serious a board's state is, the worst first: fixed values.
SEVERITY = ["failed", "suspicious", "healthy_with_fallback", "healthy", "disabled", "never_verified"]


def postings(rows: DataFrame, *, query: str | None = None, company_id: str | None = None, location: str | None = None, active: bool | None = None, posted_since: str | None = None, first_seen_since: Column | None = None) -> DataFrame:
    """Inventory rows that pass each filter that is given."""
    if query:
        rows = rows.where(text_search(query, F.col("title"), F.col("description"), F.col("company_name"), F.col("location")))
    if company_id:
        rows = rows.where(F.col("company_id") == company_id)
    if location:
        rows = rows.where(text_search(location, F.col("location")))
    if active is not None:
        rows = rows.where(F.col("active") == active)
    if posted_since:
        rows = rows.where(F.try_to_date("posted_at") >= F.to_date(F.lit(posted_since)))
    if first_seen_since is not None:
        rows = rows.where(F.col("first_seen_day") >= first_seen_since)
    return rows


def run_jobs(frozen: DataFrame, *, event: str | None = None, relevant: bool | None = None, min_score: float | None = None) -> DataFrame:
    """Frozen rows of runs; a row that isn't analysed isn't relevant and has no points."""
    if event:
        frozen = frozen.where(F.col("event") == event)
    if relevant is not None:
        frozen = frozen.where(F.coalesce("is_relevant", F.lit(False)) == relevant)
    if min_score is not None:
        frozen = frozen.where(F.coalesce("relevance_score", F.lit(0.0)) >= min_score)
    return frozen


def relevance(rows: DataFrame, *, query: str | None = None, company_id: str | None = None, status: str | None = None, family: str | None = None, change_type: str | None = None, relevant_only: bool = False, min_score: float | None = None, posted_since: str | None = None, first_seen_since: Column | None = None, target_only: bool = True) -> DataFrame:
    """Active analysed postings that pass each filter that is given; ``rows``: the inventory joined with its analysis.

    ``target_only``: those whose normal location names India. A row without points fails any ``min_score``.
    """
    rows = postings(rows.where("active"), query=query, company_id=company_id, posted_since=posted_since, first_seen_since=first_seen_since)
    if target_only:
        rows = rows.where(mentions_india(F.col("normalized_location")))
    for name, value in (("relevance_status", status), ("role_family", family), ("last_change_type", change_type)):
        if value:
            rows = rows.where(F.col(name) == value)
    rows = rows.where("is_relevant") if relevant_only else rows
    return rows if min_score is None else rows.where(F.col("relevance_score") >= min_score)


def relevance_page(rows: DataFrame, number: int = 1, size: int = 50, **filters) -> DataFrame:
    """One page of :func:`relevance`, relevant postings first, then by score, company and title (then by key), with total and pages."""
    order = [F.desc("is_relevant"), F.desc("relevance_score"), "company_name", "title", "company_id", "external_id"]
    return page(relevance(rows, **filters), order, number, size)


#: The order of a run's events. Fixed values.
EVENT_ORDER = ["new", "changed", "closed"]


def run_page(frozen: DataFrame, run, number: int = 1, size: int = 50, *, query: str | None = None, company_id: str | None = None, **filters) -> DataFrame:
    """One page of a run's frozen rows with names and titles: new, changed, closed and other events, better scores first, with total and pages."""
    rows = run_jobs(frozen.where(F.col("run") == run), **filters)
    if query:
        rows = rows.where(text_search(query, F.col("title"), F.col("company_name"), F.col("location")))
    if company_id:
        rows = rows.where(F.col("company_id") == company_id)
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, EVENT_ORDER)), F.col("event")), F.lit(0).cast("long")), F.lit(len(EVENT_ORDER) + 1).cast("long"))
    return page(rows, [rank, F.desc(F.coalesce("relevance_score", F.lit(-1.0))), "company_name", "title", "company_id", "external_id"], number, size)


def lookup(rows: DataFrame, **key) -> DataFrame:
    """The rows of one key, such as run, company_id and external_id."""
    for name, value in key.items():
        rows = rows.where(F.col(name) == value)
    return rows


def relevance_stats(rows: DataFrame) -> DataFrame:
    """All figures of the analysis in one row; ``rows``: the inventory left-joined with its analysis (no status: not analysed).

    active_jobs, analyzed, pending, relevant_jobs, new_changed, relevant_new_changed and the maps ``statuses`` and ``filter_reasons``.
    """
    active = rows.where("active")
    recent, done, good = F.col("last_change_type").isin("new", "changed"), F.col("relevance_status").isNotNull(), F.coalesce("is_relevant", F.lit(False))
    counted = active.groupBy("relevance_status", F.when(F.col("relevance_status") == "filtered", F.coalesce("filter_reason", F.lit("unknown"))).alias("reason")).agg(
        F.count("*").alias("n"), F.count_if(good).alias("good"), F.count_if(done & recent).alias("recent"), F.count_if(good & recent).alias("good_recent")
    )
    total = lambda c, when=None: F.coalesce(F.sum(c if when is None else F.when(when, F.col(c))), F.lit(0))
    # a status or a reason is a row by now
    tally = lambda name: F.aggregate(F.collect_list(F.when(F.col(name).isNotNull(), F.struct(F.col(name).alias("k"), "n"))), F.create_map().cast("map<string,bigint>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x["k"]), F.create_map(x["k"], F.coalesce(F.try_element_at(m, x["k"]), F.lit(0).cast("long")) + x["n"])))
    figures = counted.agg(total("n").alias("active_jobs"), total("n", done).alias("analyzed"), total("good").alias("relevant_jobs"), total("recent").alias("new_changed"), total("good_recent").alias("relevant_new_changed"), tally("relevance_status").alias("statuses"), tally("reason").alias("filter_reasons"))
    return figures.withColumn("pending", F.col("active_jobs") - F.col("analyzed"))


def boards(rows: DataFrame, *, query: str = "", enabled: bool | None = None, health: str | None = None, source: str | None = None) -> DataFrame:
    """Boards by a text in name or id, by switch, state and source type."""
    if text := query.strip().lower():
        rows = rows.where(F.lower("company_name").contains(text) | F.lower("company_id").contains(text))
    if enabled is not None:
        rows = rows.where(F.col("enabled") == enabled)
    if health:
        rows = rows.where(F.col("health") == health)
    return rows.where(F.col("source_type") == source) if source else rows


def run_list(runs: DataFrame, run_type: str | None = None, limit: int = 100) -> DataFrame:
    """The newest runs, of one type or of all."""
    rows = runs if run_type is None else runs.where(F.col("run_type") == run_type)
    return rows.orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)


def run_detail(results: DataFrame, run_id) -> DataFrame:
    """A run's results by rank, those without one last, then by name, with their ``place``; ``payload`` as an object, empty where it isn't one.

    results: run_id, company_id, company_name, rank and payload, a JSON text.
    """
    parsed = F.try_parse_json("payload")
    rows = results.where(F.col("run_id") == run_id).withColumn("payload", F.coalesce(F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed), F.parse_json(F.lit("{}"))))
    order = [F.coalesce("rank", F.lit(999999)), "company_name", "company_id"]
    # a row for each board of one run
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy(*order)))


def page(rows: DataFrame, order: list, number: int = 1, size: int = 50) -> DataFrame:
    """One page in ``order``, with ``total`` rows and ``pages`` of all that was found; size is held to 1 to 200."""
    number, size = max(1, number), min(200, max(1, size))
    total = rows.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))
    shown = rows.orderBy(*order).offset((number - 1) * size).limit(size)
    return shown.withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one").drop("_one")  # one row


def severity(status: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for i, name in enumerate(SEVERITY):
        out = out.when(status == name, i)
    return out.otherwise(len(SEVERITY))
