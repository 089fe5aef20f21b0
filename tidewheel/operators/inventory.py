"""Snapshot merge, change events, versions, run history and delivery sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.text import content_hash, numeric_id
from tidewheel.operators.stored import stored

KEY = ["company_id", "external_id"]


def merge(state: DataFrame, snapshot: DataFrame, run: Column, complete: DataFrame | None = None) -> DataFrame:
    """The inventory after a snapshot.

    state: KEY, content_hash, first_seen, last_seen, changed_at, active, last_change_type; snapshot: KEY,
    content_hash, one row a key; complete: (company_id, complete), companies missing there or false keep what
    the snapshot lacks active. Keys of the snapshot become active; a reappearing one is compared with its old text.
    A state row without a hash gets that of its title, location and description, where the state has them.
    """
    if {"title", "location", "description"} <= set(state.columns):
        state = state.withColumn("content_hash", F.coalesce(F.nullif("content_hash", F.lit("")), content_hash(F.col("title"), F.col("location"), F.col("description"))))
    s, n = state.withColumn("_known", F.lit(True)).alias("s"), snapshot.select(*KEY, F.col("content_hash").alias("new_hash")).alias("n")
    joined = s.join(n, KEY, "full_outer")
    if complete is not None:
        joined = joined.join(complete.select("company_id", F.col("complete").alias("_complete")), "company_id", "left")
    here, known = F.col("new_hash").isNotNull(), F.coalesce("_known", F.lit(False))
    deactivate = F.lit(False) if complete is None else F.coalesce(F.col("_complete"), F.lit(False))
    change = F.when(~known, "new").when(~F.col("content_hash").eqNullSafe(F.col("new_hash")), "changed").otherwise("unchanged")
    return joined.select(
        *KEY,
        F.coalesce("new_hash", "content_hash").alias("content_hash"),
        F.coalesce("first_seen", run).alias("first_seen"),
        F.when(here, run).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(here & (change != "unchanged"), run).otherwise(F.col("changed_at")).alias("changed_at"),
        F.when(here, True).when(deactivate, False).otherwise(F.col("active")).alias("active"),
        F.when(here, change).otherwise(F.col("last_change_type")).alias("last_change_type"),
    )


def completeness(found: Column, previous: Column, allow_zero: Column, threshold: float = 0.8) -> Column:
    """Whether a snapshot may deactivate what it lacks: no large drop, or an allowed zero."""
    drop = (previous > 0) & (found < previous * (1 - threshold))
    return ((found > 0) & ~F.coalesce(drop, F.lit(False))) | ((found == 0) & allow_zero)


def merge_counters(before: DataFrame, after: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(company_id, new, existing, deactivated): deactivated is the net loss of active rows."""
    count = lambda df, name: df.where("active").groupBy("company_id").agg(F.count("*").alias(name))
    known = snapshot.join(before.select(*KEY, F.lit(1).alias("known")), KEY, "left").groupBy("company_id").agg(F.count_if(F.col("known").isNull()).alias("new"), F.count("known").alias("existing"))
    joined = known.join(count(before, "was"), "company_id", "full_outer").join(count(after, "now"), "company_id", "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select("company_id", zero("new").alias("new"), zero("existing").alias("existing"), F.greatest(F.lit(0), zero("was") - zero("now")).alias("deactivated"))


def replay(snapshots: DataFrame) -> DataFrame:
    """Every run's events of complete snapshots in one pass: (run, KEY, content, event, observed).

    A key is new where the board's previous run lacks it, and closed in the first run that lacks it. Windows run
    over a key's own history, so no state is carried from run to run.
    """
    runs = snapshots.select("company_id", "run").distinct()
    ordered = runs.withColumns({"previous_run": F.lag("run").over(Window.partitionBy("company_id").orderBy("run")), "next_run": F.lead("run").over(Window.partitionBy("company_id").orderBy("run"))})
    w = Window.partitionBy(*KEY).orderBy("run")
    rows = snapshots.join(ordered, ["company_id", "run"]).withColumns({"_run": F.lag("run").over(w), "_content": F.lag("content").over(w), "_next": F.lead("run").over(w)})
    there = F.coalesce(F.col("_run") == F.col("previous_run"), F.lit(False))
    event = F.when(~there, "new").when(F.col("_content") != F.col("content"), "changed").otherwise("unchanged")
    observed = rows.select("run", *KEY, "content", event.alias("event"), F.lit(True).alias("observed"))
    gone = rows.where("next_run is not null and (_next is null or _next != next_run)")
    return observed.unionByName(gone.select(F.col("next_run").alias("run"), *KEY, "content", F.lit("closed").alias("event"), F.lit(False).alias("observed")))


def run_events(before: DataFrame, snapshot: DataFrame, complete: DataFrame) -> DataFrame:
    """One run: the active pre-image (KEY, content_hash) against a snapshot: (KEY, content_hash, event, observed)."""
    old = before.select(*KEY, F.col("content_hash").alias("old_hash"))
    joined = old.join(snapshot.select(*KEY, "content_hash"), KEY, "full_outer").join(complete, "company_id", "left")
    event = F.when(F.col("old_hash").isNull(), "new").when(F.col("content_hash").isNull(), "closed").when(F.col("old_hash") != F.col("content_hash"), "changed").otherwise("unchanged")
    rows = joined.withColumn("event", event).where("event != 'closed' or coalesce(complete, false)")
    return rows.select(*KEY, F.coalesce("content_hash", "old_hash").alias("content_hash"), "event", (F.col("event") != "closed").alias("observed"))


def add_versions(versions: DataFrame, rows: DataFrame) -> DataFrame:
    """Content versions: the first writer of (KEY, content_hash) stays."""
    key = [*KEY, "content_hash"]
    first = rows.groupBy(*key).agg(F.min("run").alias("run"))
    return versions.unionByName(first.join(versions.select(*key), key, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old ones of their keys; columns only one side has are null on the other."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def first_by(rows: DataFrame, key: list, order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_place = 1").drop("_place")


def delivery_modes(runs: DataFrame) -> DataFrame:
    """Finalised fetch runs with their mode: the first by (created_at, run) is the baseline."""
    first = runs.agg(F.min(F.struct("created_at", "run")).alias("first"))
    return runs.join(F.broadcast(first), F.lit(True)).select("run", F.when(F.struct("created_at", "run") == F.col("first"), "baseline").otherwise("incremental").alias("mode"))  # one row


def delivery(events: DataFrame, modes: DataFrame, eligible: Column) -> DataFrame:
    """A baseline run delivers all observed eligible rows, the others new and changed ones."""
    take = F.when(F.col("mode") == "baseline", F.col("observed")).otherwise(F.col("event").isin("new", "changed"))
    return events.join(F.broadcast(modes), "run").where(take & eligible)  # a row for each run


def dealt(df: DataFrame, order: list[str], shards: int) -> DataFrame:
    """Adds ``shard``: rows in ``order`` (nulls first) are dealt in turn.

    The place of a row is the count of the ranges before its own, of a range-partitioned table, plus its place there;
    only a count a range is summed up.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = stored(ranged.withColumns({"_range": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at"), "dealt")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_c"))  # a row a range: n at most
    before = counts.select("_range", (F.sum("_c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    return ranged.join(F.broadcast(before), "_range").withColumn("shard", (F.coalesce("_before", F.lit(0)) + F.col("_place")) % shards).drop("_range", "_place", "_before")


def top_by(rows: DataFrame, key: list, order: list, n: int) -> DataFrame:
    """The first n rows of each key, with their ``place``."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("place") <= n)


def supplement(rows: DataFrame, more: DataFrame, key: list) -> DataFrame:
    """rows, and those of ``more`` whose key they lack."""
    return rows.unionByName(more.join(rows.select(*key), key, "left_anti"))


def copy_legacy(target: DataFrame, legacy: DataFrame, renamed: dict[str, str], key: list[str], order: list[str]) -> DataFrame:
    """The target, or, where it is empty, the rows of an older table under their new names; the first of a key by ``order`` counts.

    Columns that only the target has are null; those that only the older table has are left out.
    """
    if not target.isEmpty():
        return target
    rows = first_by(legacy, key, order).withColumnsRenamed(renamed)
    return target.limit(0).unionByName(rows.select(*(c for c in rows.columns if c in target.columns)), allowMissingColumns=True)


def listing_id(rows: DataFrame) -> Column:
    """The first run of eight digits or more in the id, else in the URL."""
    return F.coalesce(numeric_id(F.col("external_id")), numeric_id(F.col("job_url")))


def covered(provider: DataFrame, official: DataFrame, details: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A provider's postings and those that only the official listing has, and a verdict for each board: (rows, verdicts).

    provider: company_id, external_id, job_url and more; official: company_id, id, the listing's records, each id once or
    more; details: company_id, id and the provider's columns, the official pages of records; totals: company_id, before,
    after, what the listing said at its first and last page. verdicts: company_id, expected, enumerated, missing, problem.
    A board's problem is, in this order: no total, totals that differ, fewer records than the total, records that
    neither side returned; null where there is none. Rows of boards with a problem, or of boards without totals, aren't returned.
    """
    key = ["company_id", "id"]
    listed = official.select(*key).distinct()
    held = provider.select("company_id", listing_id(provider).alias("id")).where("id is not null").distinct()
    lacking = listed.join(held, key, "left_anti")
    found = first_by(details.join(lacking, key, "left_semi"), key, [F.asc(c) for c in ("external_id", "job_url")])
    more = found.select("company_id", *(c for c in provider.columns if c != "company_id"))
    returned = held.unionByName(more.select("company_id", listing_id(more).alias("id")).where("id is not null"))
    absent = listed.join(returned, key, "left_anti").groupBy("company_id").agg(F.count("*").alias("missing"))
    counted = totals.join(listed.groupBy("company_id").agg(F.count("*").alias("enumerated")), "company_id", "left").join(absent, "company_id", "left")
    none = F.lit(0).cast("long")
    counted = counted.select("company_id", F.col("before").alias("expected"), "after", F.coalesce("enumerated", none).alias("enumerated"), F.coalesce("missing", none).alias("missing"))
    problem = (
        F.when(F.col("expected").isNull() | F.col("after").isNull(), "total_unavailable")
        .when(F.col("expected") != F.col("after"), "changed_during_fetch")
        .when(F.col("enumerated") < F.col("expected"), "incomplete_pagination")
        .when(F.col("missing") > 0, "coverage_failed")
    )
    verdicts = counted.select("company_id", "expected", "enumerated", "missing", problem.alias("problem"))
    rows = provider.withColumn("origin", F.lit("provider")).unionByName(more.withColumn("origin", F.lit("official")))
    return rows.join(verdicts.where("problem is null").select("company_id"), "company_id", "left_semi"), verdicts
