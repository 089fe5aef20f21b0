"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` positions. Each shard owns ``vnodes`` pseudo-random
ones, and a key belongs to the first owner at or after the cell its hash falls
into. A shard takes no more rows than its bound; keys that overflow a full
shard continue clockwise to the next distinct shard with room. With the bounds
``floor(n / shards)`` and one more for the first ``n mod shards`` shards of a
pseudo-random order, every shard ends full, so row counts differ by one at most
(law ``rows``). A looser ``slack`` gives the usual bound of ``(1 + slack) n /
shards`` rows and moves fewer keys when shards come or go.

Rows do not meet in one task: they are counted by cell (the driver holds
``CELLS`` counts, whatever the input), the walk round the ring places counts,
and each row finds its place by its rank within its cell. Ranks are counted by
(cell, finer hash, part of the written key table), so copies of one key are
also dealt to many tasks.

Defined cases: a null text has 8 bytes of size and the CRC of the empty text;
a null doc_id is a key like any other; repeated rows each get a slot; an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import Workspace, fresh

CELLS, VNODES = 1 << 14, 128


def _point(label: str) -> int:
    return int.from_bytes(hashlib.md5(label.encode()).digest()[:8], "big")


def ring(shards: int, vnodes: int = VNODES) -> np.ndarray:
    """The owner of each cell. Of points in one cell, the one with the least hash owns it."""
    points = sorted((_point(f"shard {s} node {v}"), s) for s in range(shards) for v in range(vnodes))
    owner = np.full(CELLS, -1, np.int64)
    for point, s in reversed(points):
        owner[point % CELLS] = s
    held = np.flatnonzero(owner >= 0)
    return owner[held[np.searchsorted(held, np.arange(CELLS)) % len(held)]]


def bounds(rows: int, shards: int, slack: float = 0.0) -> np.ndarray:
    """Rows each shard may take; with no slack they sum up to ``rows``."""
    if slack:
        return np.full(shards, int(np.ceil(rows * (1 + slack) / shards)))
    order = sorted(range(shards), key=lambda s: _point(f"bound {s}"))
    most = np.full(shards, rows // shards)
    most[order[: rows % shards]] += 1
    return most


def place(counts: dict[int, int], owner: np.ndarray, most: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, last rank, shard, first slot): cells in the order of a hash, each walked clockwise."""
    change = np.flatnonzero(owner != np.roll(owner, 1)) if len(set(owner.tolist())) > 1 else np.array([0])
    used, out = np.zeros(len(most), np.int64), []
    for cell in sorted(counts, key=lambda c: _point(f"cell {c}")):
        left, rank = counts[cell], 0
        at = int(np.searchsorted(change, cell, side="right")) - 1
        for step in range(len(change)):
            shard = int(owner[cell]) if step == 0 else int(owner[change[(at + step) % len(change)]])
            n = int(min(left, most[shard] - used[shard]))
            if n > 0:
                out.append((cell, rank, rank + n - 1, shard, int(used[shard])))
                used[shard], rank, left = used[shard] + n, rank + n, left - n
            if not left:
                break
    return out


def assign(docs: DataFrame, shards: int, *, key: str = "doc_id", slack: float = 0.0, vnodes: int = VNODES, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """``docs`` with a shard and a slot, gapless from 0 within the shard. Give it the columns to carry, not texts."""
    spark = docs.sparkSession
    ws = Workspace(spark, "ring-shards")
    shard_col, slot_col = fresh(docs, shard_col), fresh(docs, slot_col)
    h = F.xxhash64(F.lit(20), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    names = {c: fresh(docs, c) for c in ("_cell", "_fine", "_part", "_id", "_rank", "_base")}
    cell, fine, part, uid, rank, base = names.values()
    keyed = ws.save(
        docs.withColumns({cell: F.pmod(h, F.lit(CELLS)).cast("int"), fine: F.pmod(F.shiftright(h, 20), F.lit(1024)).cast("int"), part: F.spark_partition_id(), uid: F.monotonically_increasing_id()}),
        "keys",
    )
    groups = keyed.groupBy(cell, fine, part).agg(F.count("*").alias("n"))
    before = Window.partitionBy(cell).orderBy(fine, part).rowsBetween(Window.unboundedPreceding, -1)
    groups = ws.save(groups.withColumn(base, F.coalesce(F.sum("n").over(before), F.lit(0))), "groups")
    counts = {r[0]: r[1] for r in groups.groupBy(cell).agg(F.sum("n")).collect()}  # CELLS rows at most
    plan = place(counts, ring(shards, vnodes), bounds(sum(counts.values()), shards, slack))
    p = {c: fresh(docs, f"_plan_{c}") for c in ("cell", "first", "last", "slot")}
    places = spark.createDataFrame(plan, f"`{p['cell']}` int, `{p['first']}` long, `{p['last']}` long, `{shard_col}` int, `{p['slot']}` long")
    local = F.row_number().over(Window.partitionBy(cell, fine, part).orderBy(uid))
    ranked = keyed.withColumn(rank, local).join(groups.drop("n"), [cell, fine, part]).withColumn(rank, F.col(rank) - 1 + F.col(base))
    # CELLS + shards rows of places at most: a cell is split only where a shard fills up
    placed = ranked.join(F.broadcast(places), (F.col(cell) == F.col(p["cell"])) & F.col(rank).between(F.col(p["first"]), F.col(p["last"])))
    return placed.select(*docs.columns, shard_col, (F.col(rank) - F.col(p["first"]) + F.col(p["slot"])).alias(slot_col))


def report(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per document under the law ``rows``."""
    sized = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    out = assign(sized, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
