"""MinHash near-duplicate removal.

Many universal hash minima of each document's distinct five-word shingles,
``BANDS`` bands of ``ROWS`` minima, candidates checked on signatures and then
on full sets, and connected components by alternating large-star and small-star
(:mod:`tidewheel.llm.near`). At the threshold of 0.85 a pair shares no band with
a probability of 3e-6; more similar pairs are missed less still.

Copies of a text are one node from the start (its 64-bit hash), so they cost
one row each and no links.

Defined cases: a null text or one without words has an empty set, is linked
with nothing and stays; a text of fewer than five words has one shingle; a
repeated row shares its twin's component; a null doc_id takes part but is never
a component's id where another document has one; an empty table gives an empty
table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import Workspace, fresh
from tidewheel.llm.lines import Texts, slices
from tidewheel.llm.near import SETS, candidates, link, rarity, set_rows
from tidewheel.llm.shingles import MinHash

BANDS, ROWS = 40, 8


def _banded(bands: int, rows: int):
    schema = pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def scan(batches):
        family = MinHash(bands, rows)
        for batch in batches:
            for part, texts in slices(batch):
                sets = Texts(texts).sets()
                full = [i for i, s in enumerate(sets) if len(s)]
                values = iter(family.band_values(family.minima([sets[i] for i in full])).tolist())
                found = [next(values) if len(s) else [] for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(found, pa.list_(pa.int64()))], schema=schema)

    return scan


def full_sets(texts: DataFrame, bands: int, rows: int) -> DataFrame:
    """(node, n, set, sig, bits) from (node, text); see :func:`tidewheel.llm.near.set_rows`."""

    def scan(batches):
        family = MinHash(bands, rows)
        for batch in batches:
            for part, some in slices(batch):
                yield set_rows(part.column("node"), Texts(some).sets(), family)

    return texts.mapInArrow(scan, SETS)


def near_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, node, n_shingles, component_id) for each row of docs. threshold: in hundredths."""
    spark = docs.sparkSession
    ws = Workspace(spark, "near-dedup")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("node"), F.col(text_col).alias("text"))
    banded = ws.save(source.mapInArrow(_banded(bands, rows), "node long, doc_id long, n long, bands array<long>"), "banded")
    firsts = ws.save(banded.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first")), "firsts")
    held = candidates(ws, banded.where("n > 0").join(firsts, "node").where("doc_id <=> first").select("node", "bands"))
    wanted = held.select("node").distinct().join(firsts, "node")
    texts = source.join(wanted, (source["node"] == wanted["node"]) & source["doc_id"].eqNullSafe(wanted["first"])).select(source["node"], "text").dropDuplicates(["node"])
    sets = ws.save(full_sets(texts, bands, rows), "sets")
    roots = link(ws, held, sets, rarity(ws, sets), threshold, words=-(-bands * rows // 64))
    of_root = firsts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = of_root.groupBy("root").agg(F.min("first").alias("component_id"))
    by_node = ws.save(of_root.join(least, "root").select("node", "component_id"), "by_node")
    # each node once; the hot side is the rows of a text with many copies, which Spark splits
    grouped = banded.where("n > 0").select("doc_id", "node", "n").join(by_node, "node", "left")
    alone = banded.where("n = 0").select("doc_id", "node", "n", F.col("doc_id").alias("component_id"))
    return grouped.select("doc_id", "node", "n", "component_id").unionByName(alone).withColumnRenamed("n", "n_shingles")


def report(docs: DataFrame) -> DataFrame:
    """One row per document."""
    out = near_components(docs)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, *, threshold: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of docs that stay: one of each component (a repeated row goes too), and those linked with nothing."""
    found = near_components(docs, threshold=threshold, bands=bands, rows=rows).where("n_shingles > 0 and doc_id <=> component_id").select("doc_id", "node").distinct()
    node, mark = fresh(docs, "node"), fresh(docs, "first")
    keyed = docs.withColumn(node, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    kept = found.withColumnsRenamed({"doc_id": mark, "node": node})
    stay = keyed.join(kept, (keyed[node] == kept[node]) & keyed["doc_id"].eqNullSafe(kept[mark]), "left_semi").dropDuplicates([node, "doc_id"])
    empty = keyed.where("text is null or not text rlike '[^ \\\\x09-\\\\x0D]'")
    return stay.unionByName(empty).select(*docs.columns)
