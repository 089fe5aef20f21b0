"""Continuous snapshot merge: snapshot files are merged as they arrive.

All runs of a batch are merged in one plan, by windows over a key's own
occurrences, not run by run. Whether a run is complete depends on how many
postings its company has active by then, so those are counted first: a row of a
run adds to the active ones exactly if the key's previous occurrence lies before
the last complete run. Counts by company, run and previous occurrence are small;
a fold over each company's runs gives its last complete run, and with that every
key's state follows by itself.

The state lies in buckets of companies. A batch reads and rewrites the buckets of
its own companies only, and a manifest, written last, names for each bucket the batch that
holds it: a batch without its manifest never happened, one with it is skipped when it
comes again. Buckets that neither of the two newest manifests names are deleted.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators.inventory import KEY, completeness
from tidewheel.operators.stored import delete

STATE = "company_id string, external_id string, content_hash string, first_seen string, last_seen string, changed_at string, active boolean, last_change_type string"
#: Buckets of companies, and files a bucket is written in, which part a large company.
BUCKETS, FILES = 64, 4
#: What stands for "active before the batch" and "not active" among run numbers.
_BEFORE, _NEVER = -(2**62), -(2**62) - 1


def last_complete(keys: DataFrame) -> DataFrame:
    """(company_id, complete): the last run of a company that may take postings away, null for none.

    keys: company_id, active (before), seen: an array of (run, content) in order.
    """
    previous = lambda x, i: F.when(i > 0, F.get("seen", i - 1)["run"]).otherwise(F.when(F.col("active"), _BEFORE).otherwise(_NEVER))
    met = keys.select("company_id", F.explode(F.transform("seen", lambda x, i: F.struct(x["run"].alias("run"), previous(x, i).alias("previous")))).alias("x"))
    counts = met.groupBy("company_id", "x.run", "x.previous").agg(F.count("*").alias("n"))
    by_run = counts.groupBy("company_id", "run").agg(F.collect_list(F.struct("previous", "n")).alias("parts"))
    runs = by_run.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("run", "parts"))).alias("runs"))
    had = keys.groupBy("company_id").agg(F.count_if("active").alias("had"))

    def step(s: Column, x: Column) -> Column:
        found = F.aggregate(x["parts"], F.lit(0).cast("long"), lambda a, p: a + p["n"])
        added = F.aggregate(x["parts"], F.lit(0).cast("long"), lambda a, p: a + F.when(p["previous"] < s["since"], p["n"]).otherwise(0))
        whole = completeness(found, s["had"], F.lit(False))
        return F.struct(F.when(whole, found).otherwise(s["had"] + added).alias("had"), F.when(whole, x["run"]).otherwise(s["since"]).alias("since"))

    first = F.struct(F.col("had"), F.lit(_BEFORE).cast("long").alias("since"))
    since = F.aggregate("runs", first, step)["since"]
    return runs.join(had, "company_id").select("company_id", F.nullif(since, F.lit(_BEFORE).cast("long")).alias("complete"))


def merge_runs(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The state after all runs of ``batch`` (run, company_id, external_id, content), in the order of their numbers.

    Rows of one key and run count once, by their greatest content; a null content
    is an empty one; rows without a key or a run are left out.
    """
    rows = batch.where("company_id is not null and external_id is not null and run is not null")
    once = rows.groupBy(*KEY, F.col("run").cast("long").alias("run")).agg(F.max(F.coalesce("content", F.lit(""))).alias("content"))
    seen = once.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("run", "content"))).alias("seen"))
    keys = state.join(seen, KEY, "full_outer").withColumns({"active": F.coalesce("active", F.lit(False)), "seen": F.coalesce("seen", F.array().cast("array<struct<run:bigint,content:string>>"))})
    joined = keys.join(last_complete(keys), "company_id", "left")
    here, last = F.size("seen") > 0, F.element_at("seen", -1)
    old = lambda i: F.when(i > 0, F.get("seen", i - 1)["content"]).otherwise(F.col("content_hash"))
    changes = F.transform("seen", lambda x, i: F.struct(x["run"].alias("run"), F.when(old(i).isNull(), "new").when(old(i) != x["content"], "changed").otherwise("unchanged").alias("change")))
    real = F.filter(F.col("changes"), lambda x: x["change"] != "unchanged")
    return joined.withColumn("changes", changes).select(
        *KEY,
        F.when(here, last["content"]).otherwise(F.col("content_hash")).alias("content_hash"),
        F.coalesce("first_seen", F.get("seen", F.lit(0))["run"].cast("string")).alias("first_seen"),
        F.when(here, last["run"].cast("string")).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(F.size(real) > 0, F.element_at(real, -1)["run"].cast("string")).otherwise(F.col("changed_at")).alias("changed_at"),
        F.when(here, F.col("complete").isNull() | (last["run"] >= F.col("complete"))).otherwise(F.col("active") & F.col("complete").isNull()).alias("active"),
        F.when(here, F.element_at("changes", -1)["change"]).otherwise(F.col("last_change_type")).alias("last_change_type"),
    )


class Store:
    """The buckets and manifests under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.jvm = spark, root, spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(folder))] if self.fs.exists(self._path(folder)) else []

    def batches(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifest") if n.endswith(".json") and n[0] != ".")

    def manifest(self, batch: int) -> dict[str, int]:
        """The batch that holds each bucket."""
        stream = self.fs.open(self._path(f"manifest/{batch}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The newest state, of some buckets."""
        done = self.batches()
        held = self.manifest(done[-1]) if done else {}
        paths = [f"{self.root}/state/batch={b}/bucket={k}" for k, b in held.items() if buckets is None or int(k) in buckets]
        return self.spark.read.schema(STATE).parquet(*paths) if paths else self.spark.createDataFrame([], STATE)

    def commit(self, batch: int) -> None:
        """Names the buckets that ``batch`` has written, and drops what no one reads any more."""
        done = self.batches()
        held = self.manifest(done[-1]) if done else {}
        held |= {n.removeprefix("bucket="): batch for n in self._names(f"state/batch={batch}") if n.startswith("bucket=")}
        made = self._path(f"manifest/.{batch}")
        out = self.fs.create(made, True)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        self.fs.rename(made, self._path(f"manifest/{batch}.json"))
        if not done:
            return
        kept = {(k, b) for m in (held, self.manifest(done[-1])) for k, b in m.items()}
        for old in self._names("state"):
            number = int(old.removeprefix("batch="))
            here = [n.removeprefix("bucket=") for n in self._names(f"state/{old}") if n.startswith("bucket=")]
            unused = [k for k in here if (k, number) not in kept]
            for path in [f"state/{old}"] if len(unused) == len(here) else [f"state/{old}/bucket={k}" for k in unused]:
                delete(self.spark, f"{self.root}/{path}")
        for number in done[:-1]:
            delete(self.spark, f"{self.root}/manifest/{number}.json")


def bucket_of(company_id: Column) -> Column:
    return F.pmod(F.xxhash64(company_id), F.lit(BUCKETS)).cast("int")


def merge_batch(root: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merges a batch into the state under ``root``; a batch that is there already changes nothing."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = Store(spark, root)
        done = store.batches()
        if done and done[-1] >= batch_id:
            return
        buckets = [r[0] for r in batch.select(bucket_of(F.col("company_id"))).distinct().collect()]  # BUCKETS rows at most
        merged = merge_runs(store.read(buckets), batch).withColumn("bucket", bucket_of(F.col("company_id")))
        dealt = merged.repartition("bucket", F.pmod(F.xxhash64("external_id"), F.lit(FILES)))
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/state/batch={batch_id}")
        store.commit(batch_id)

    return apply


def start(spark: SparkSession, source: str, schema: str, root: str, checkpoint: str, files: int = 1):
    """A query that merges snapshot files (run, company_id, external_id, content) under source into root, ``files`` a batch."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.foreachBatch(merge_batch(root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark: SparkSession, root: str) -> DataFrame:
    return Store(spark, root).read()
