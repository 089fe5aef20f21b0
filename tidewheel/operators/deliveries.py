"""Artifacts of runs: frozen scores, payloads and manifests under one folder, by a commit protocol.

A commit first writes the frozen rows and the payloads of its runs, each in a
partition of its own, and then a log entry with a manifest row for each run. Only
commits whose log entry is whole count, so a commit that breaks off leaves
nothing that anyone reads. The newest manifest row of a run says which commit
holds its payload and which its frozen rows.

``finalize`` writes a run once; a run that has a manifest is left alone.
``deliver`` rewrites the payloads whose schema or location rules are old, from
the frozen rows, so later changes of the inventory don't matter. Both handle all
their runs in one plan, and neither writes anything where nothing is to do.
One writer at a time is assumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators import location
from tidewheel.operators.inventory import KEY
from tidewheel.operators.matching import placed
from tidewheel.operators.runs import FROZEN, freeze, in_target
from tidewheel.operators.stored import Scratch

#: Versions of the payloads' form: as finalized, and as delivered; version of the location rules.
FINALIZED, DELIVERED, LOCATION_RULES = 1, 3, "places-1"

_FROZEN = "company_id string, external_id string, content string, event string, observed boolean, normalized_location string, role_family string, min_experience double, max_experience double, relevance_score double, relevance_status string, is_relevant boolean"
_PAYLOAD = "place long, company_id string, external_id string, event string, job string"
SUMMARY = ["snapshot_jobs", "jobs_new", "jobs_changed", "jobs_unchanged", "jobs_closed", "baseline_relevant", "new_relevant", "changed_relevant", "ai_input_count"]
_MANIFEST = ", ".join(
    ["run string", "frozen_commit long", "schema_version int", "delivery_mode string", "location_ruleset string", "target_country string", "run_created_at string", "run_started_at string", "generated_at string", *(f"{c} long" for c in SUMMARY), "payload_sha256 string"]
)


def digest(payload: DataFrame) -> DataFrame:
    """(run, ai_input_count, payload_sha256): the digest of all rows' digests by place, whatever files they are in."""
    lines = payload.select("run", "place", F.sha2("job", 256).alias("line"))
    # a run's lines are folded by blocks of places first
    block = F.floor(F.col("place") / 10_000)
    fold = lambda df, order, text: df.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n"), 256).alias("line"))
    blocks = fold(lines.withColumn("n", F.lit(1)).groupBy("run", block.alias("block")), "place", "line")
    return fold(blocks.groupBy("run"), "block", "line").select("run", F.col("n").alias("ai_input_count"), F.col("line").alias("payload_sha256"))


class Deliveries:
    """The artifacts under ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, country: str | None = "india"):
        self.spark, self.root, self.country = spark, root.rstrip("/"), country
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _folders(self, name: str) -> list[int]:
        found = self.fs.listStatus(self._path(name)) if self.fs.exists(self._path(name)) else []
        return sorted(int(n.removeprefix("commit=")) for n in (s.getPath().getName() for s in found) if n.startswith("commit="))

    def commits(self) -> list[int]:
        """The commits that count."""
        return [n for n in self._folders("log") if self.fs.exists(self._path(f"log/commit={n}/_SUCCESS"))]

    def _table(self, name: str, schema: str) -> DataFrame:
        # partitions of all commits; only those that a manifest names are read
        full = f"{schema}, run string, commit long"
        return self.spark.read.schema(full).parquet(f"{self.root}/{name}") if self._folders(name) else self.spark.createDataFrame([], full)

    def manifest(self) -> DataFrame:
        """The newest row of each run, with the commit that wrote it."""
        paths = [f"{self.root}/log/commit={n}" for n in self.commits()]
        full = f"{_MANIFEST}, commit long"
        if not paths:
            return self.spark.createDataFrame([], full)
        rows = self.spark.read.schema(full).option("basePath", f"{self.root}/log").parquet(*paths)
        return rows.groupBy("run").agg(F.max_by(F.struct("*"), "commit").alias("m")).select("m.*")

    def jobs(self) -> DataFrame:
        """What the runs hand on: (run, place, company_id, external_id, event, job), ``job`` as JSON, in the order of ``place``."""
        return self._table("payload", _PAYLOAD).join(self.manifest().select("run", "commit"), ["run", "commit"]).drop("commit")

    def frozen(self) -> DataFrame:
        """Every event of the finalized runs with the scores that held then."""
        return self._table("frozen", _FROZEN).join(self.manifest().select("run", F.col("frozen_commit").alias("commit")), ["run", "commit"]).drop("commit")

    def summaries(self) -> DataFrame:
        return self.manifest().select("run", *SUMMARY)

    def latest(self) -> DataFrame:
        """The newest fetch run's payload."""
        newest = self.manifest().agg(F.max(F.struct("run_created_at", "run")).alias("x")).select("x.run")
        return self.jobs().join(newest, "run")

    def lines(self, run: str) -> DataFrame:
        """One run's document as (place, line): the manifest as JSON at place 0, then a job a line."""
        head = self.manifest().where(F.col("run") == run).select(F.lit(0).cast("long").alias("place"), F.to_json(F.struct("*")).alias("line"))
        return head.unionByName(self.jobs().where(F.col("run") == run).select("place", F.col("job").alias("line"))).orderBy("place")

    def finalize(self, runs: DataFrame, events: DataFrame, analysis: DataFrame, versions: DataFrame, generated_at: str) -> DataFrame:
        """Freezes the scores of the runs that have no manifest and writes what they hand on; returns all summaries.

        runs: run, created_at, started_at; events: run, the key, content, event,
        observed; versions: the key, content and a posting's columns, company_name,
        title, location and description among them.
        """
        todo = runs.select(F.col("run").cast("string").alias("run"), F.col("created_at").cast("string").alias("run_created_at"), F.col("started_at").cast("string").alias("run_started_at"))
        todo = todo.join(self.manifest().select("run"), "run", "left_anti")
        if todo.isEmpty():
            return self.summaries()
        commit = 1 + max([0, *self._folders("log"), *self._folders("frozen"), *self._folders("payload")])
        mine = events.withColumn("run", F.col("run").cast("string")).join(todo.select("run"), "run", "left_semi")
        names = [f.name for f in self.spark.createDataFrame([], _FROZEN).schema]
        cast = {f.name: F.col(f.name).cast(f.dataType) for f in self.spark.createDataFrame([], _FROZEN).schema}
        frozen = freeze(mine, analysis).withColumns(cast).select(*names, "run")
        frozen.write.partitionBy("run").mode("overwrite").parquet(f"{self.root}/frozen/commit={commit}")
        rows = self._table("frozen", _FROZEN).where(F.col("commit") == commit).drop("commit").join(versions, [*KEY, "content"])
        ok = F.coalesce("is_relevant", F.lit(False)) & in_target(F.col("normalized_location"), self.country)
        rows = rows.withColumn("_ok", ok)
        with Scratch(self.spark, "deliveries") as held:
            self._write(held, todo, rows, F.col("event").isin("new", "changed") & F.col("_ok"), commit, {"frozen_commit": F.lit(commit), "schema_version": F.lit(FINALIZED), "delivery_mode": F.lit(None), "location_ruleset": F.lit(None), "generated_at": F.lit(generated_at), "baseline_relevant": F.lit(None)})
        return self.summaries()

    def deliver(self, versions: DataFrame, current: DataFrame | None = None, runs: list[str] | None = None) -> DataFrame:
        """Brings payloads of old form or old location rules up to date, all or those of some runs; returns the manifest.

        The first run of all that are delivered hands on every relevant posting it
        observed (baseline), the others new and changed ones. A posting is in the target
        country if its frozen location is, or if its place is so classified
        again; current: the key, content and ``raw``, a payload's JSON that
        counts while the content is still the same.
        """
        m = self.manifest()
        done = F.coalesce(F.col("delivery_mode").isin("baseline", "incremental"), F.lit(False))
        old = ~done | (F.col("schema_version") < DELIVERED) | ~F.col("location_ruleset").eqNullSafe(LOCATION_RULES)
        if runs is not None:
            old = old & F.col("run").isin(runs)
        todo = m.where(old)
        if todo.isEmpty():
            return m
        commit = 1 + max(self._folders("log") + self._folders("payload"))
        first = m.where(done | old).agg(F.min(F.struct("run_created_at", "run")).alias("_first"))
        with Scratch(self.spark, "deliveries") as held:
            # the mode counts runs that are delivered already and those of this call
            todo = held.table(todo.join(first, F.lit(True)).withColumn("delivery_mode", F.when(F.struct("run_created_at", "run") == F.col("_first"), "baseline").otherwise("incremental")).drop("_first"))
            frozen = self._table("frozen", _FROZEN).join(todo.select("run", F.col("frozen_commit").alias("commit"), "delivery_mode"), ["run", "commit"]).drop("commit")
            rows = held.table(frozen.join(versions, [*KEY, "content"]))
            rows = self._located(rows, current)
            take = F.when(F.col("delivery_mode") == "baseline", F.col("observed")).otherwise(F.col("event").isin("new", "changed")) & F.col("_ok")
            keep = ["run", "run_created_at", "run_started_at", "frozen_commit", "generated_at", "delivery_mode", *(c for c in SUMMARY if c.startswith(("snapshot", "jobs_")))]
            self._write(held, todo.select(*keep), rows, take, commit, {"schema_version": F.lit(DELIVERED), "location_ruleset": F.lit(LOCATION_RULES)})
        return self.manifest()

    def _located(self, rows: DataFrame, current: DataFrame | None) -> DataFrame:
        """Adds ``_ok``: relevant, and in the target country by the frozen location or by classifying again."""
        relevant = F.coalesce("is_relevant", F.lit(False))
        if (self.country or "").strip().lower() != "india":
            return rows.withColumn("_ok", relevant & in_target(F.col("normalized_location"), self.country))
        # only relevant rows whose frozen location doesn't settle it are classified again
        frozen = location.classify(rows.withColumn("_none", F.lit(None).cast("string")), "normalized_location", "_none", prefix="_frozen_")
        clear = F.coalesce(F.col("_frozen_status") == "india", F.lit(False))
        unclear = frozen.where(relevant & ~clear).select(*KEY, "content", "location", "description").distinct()
        if current is not None:
            unclear = unclear.join(current.select(*KEY, "content", "raw"), [*KEY, "content"], "left")
            unclear = unclear.withColumn("_key", F.to_json(F.struct(*KEY, "content")))
            found = location.structured_evidence(location.structured_values(unclear, "_key", "raw"))
            unclear = unclear.join(found.withColumnRenamed("key", "_key"), "_key", "left")
        again = location.classify(unclear, prefix="_again_", structured=current is not None).where("_again_status = 'india'").select(*KEY, "content", F.lit(True).alias("_again")).distinct()
        joined = frozen.join(again, [*KEY, "content"], "left")
        return joined.withColumn("_ok", relevant & (clear | F.coalesce("_again", F.lit(False))))

    def _write(self, held: Scratch, todo: DataFrame, rows: DataFrame, take, commit: int, columns: dict) -> None:
        """Payloads, then the log entry, of the runs ``todo``; rows: frozen rows with versions and ``_ok``."""
        hidden = {"run", "content", "observed", "event", "is_relevant", "delivery_mode"}
        job = F.struct(*(c for c in rows.columns if c[0] != "_" and c not in hidden), F.col("event").alias("event_type"), F.lit(True).alias("is_relevant"))
        order = F.struct((-F.coalesce("relevance_score", F.lit(-1.0))).alias("score"), "company_name", "title", *KEY)
        chosen = placed(rows.where(take).select("run", *KEY, "event", F.to_json(job, {"ignoreNullFields": "false"}).alias("job"), order.alias("_order")), "run", "_order", held.table)
        payload = chosen.select("place", *KEY, "event", "job", "run").repartitionByRange("run", "place").sortWithinPartitions("run", "place")
        payload.write.partitionBy("run").mode("overwrite").parquet(f"{self.root}/payload/commit={commit}")
        written = self._table("payload", _PAYLOAD).where(F.col("commit") == commit)
        event, ok = F.col("event"), F.col("_ok")
        counts = rows.groupBy("run").agg(
            F.count_if("observed").alias("snapshot_jobs"),
            *(F.count_if(event == k).alias(f"jobs_{k}") for k in ("new", "changed", "unchanged", "closed")),
            F.count_if(F.col("observed") & ok).alias("baseline_relevant"),
            *(F.count_if((event == k) & ok).alias(f"{k}_relevant") for k in ("new", "changed")),
        )
        # what an earlier manifest has counted stays
        counts = counts.select("run", *(c for c in counts.columns if c not in todo.columns))
        log = todo.join(counts, "run", "left").join(digest(written), "run", "left").withColumns({"target_country": F.lit(self.country)} | columns)
        zero = {c: F.coalesce(c, F.lit(0)) for c in SUMMARY if c != "baseline_relevant"}
        log = log.withColumns({**zero, "payload_sha256": F.coalesce("payload_sha256", F.sha2(F.lit(""), 256))})
        schema = self.spark.createDataFrame([], _MANIFEST).schema
        log.select(*(F.col(f.name).cast(f.dataType) for f in schema)).write.mode("overwrite").parquet(f"{self.root}/log/commit={commit}")

