"""Linking near-duplicates found by banding, without pairs of all copies.

Nodes are distinct texts. Nodes that share a band value form a bucket. Each
round, every bucket that still holds nodes of several components names pivots,
and each pivot is compared with the nodes of other components in the bucket,
then leaves it. The first round has one pivot a bucket, the least edited node
and so mostly the same one in all buckets of a group of copies, which links the
bulk of the group by stars; later rounds have about 4, 16, 64, ... pivots a
bucket, drawn by a hash from those outside its largest component, so most of
these are linked before they would be compared with all the others. A bucket
ends when its nodes are in one component or all those outside the largest have
been pivots. That finds every component of the graph of candidate links,
exactly, in a number of rounds that grows with the logarithm of a bucket.

Which pairs are compared at all is bounded twice. By what no other candidate
has: of n shingles, ``rare`` are in one candidate only, so two sets of sizes n
and m share ``min(n - rare_n, m - rare_m)`` at most and have ``max(n + rare_m,
m + rare_n)`` together at least. Each edit of a copy makes rare shingles, so
within a large group of edited copies nearly all pairs that the bound lets
through do link. And by one-bit signatures that lie in the bucket's rows: a
pair whose bits differ more than ``SIGMAS`` standard deviations beyond the
threshold's expectation isn't made, nor is one of small sets, which the rows
carry, that share too little. Pairs are then confirmed on full sets.

Components come from alternating large-star and small-star steps over each
round's links, contracted to the roots of the rounds before, so a later round
costs what it finds, not what all of them have found.

Every step is a join or an aggregate by key that Spark can combine before the
shuffle or split when a key is hot; no step holds a bucket or a component in
one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import Workspace
from tidewheel.llm.shingles import MinHash, signatures

SETS = "node long, n long, set binary, sig binary, bits array<long>, few array<int>"
#: How many standard deviations below the threshold a signature may lie before the pair is dropped unseen.
SIGMAS = 6


def components(ws: Workspace, links: DataFrame, name: str) -> DataFrame:
    """(node, root): root is the least node of the component. From links (u, v); nodes without links aren't in it."""
    edges = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, step = ws.save(edges, f"{name}-0"), 0
    while True:
        marks = edges.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        unsettled = marks.groupBy("n").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where("c > 1 or (c = 1 and p = 1)")
        if unsettled.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = ws.save(large, f"{name}-{step}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        step += 1
        edges, old = ws.save(small, f"{name}-{step}"), f"{name}-{step - 1}"
        ws.drop(old, f"{old}-large")


def candidates(ws: Workspace, banded: DataFrame) -> DataFrame:
    """From (node, bands): the buckets of at least two nodes, as (bucket, node)."""
    members = banded.select("node", F.explode("bands").alias("bucket"))
    active = members.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a != b").select("bucket")
    held = ws.save(members.join(active, "bucket", "left_semi").distinct(), "held")
    return held


def rarity(ws: Workspace, sets: DataFrame) -> DataFrame:
    """(node, n, rare, bits, few) of ``SETS``: the size, and how many of the shingles no other set has."""

    def spread(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [np.frombuffer(x, "<i8") for x in part.column("set").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("node").to_numpy(), [len(x) for x in found])), pa.array(np.concatenate(found))], ["node", "shingle"])

    alone = sets.select("node", "set").mapInArrow(spread, "node long, shingle long").groupBy("shingle").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
    rare = alone.groupBy("node").agg(F.count("*").alias("rare"))
    return ws.save(sets.select("node", "n", "bits", "few").join(rare, "node", "left").select("node", "n", F.coalesce("rare", F.lit(0)).alias("rare"), "bits", "few"), "rarity")


def _bits_apart(threshold: int, n: int) -> int:
    """Of n bits, how many may differ in a pair at the threshold."""
    p = (1 - threshold / 100) / 2
    return int(n * p + SIGMAS * np.sqrt(n * p * (1 - p)))


def set_rows(nodes, sets: list[np.ndarray], family: MinHash, few: int = 0) -> pa.RecordBatch:
    """Rows of ``SETS``: sorted 64-bit shingles, a byte and a bit of each minimum, and half of each shingle in sets of
    ``few`` at most. An empty set has no signature."""
    full = [i for i, s in enumerate(sets) if len(s)]
    sig: list = [None] * len(sets)
    bits: list = [None] * len(sets)
    for i, a, b in zip(full, *signatures(family.minima([sets[i] for i in full])), strict=True):
        sig[i], bits[i] = a, b
    columns = [nodes, pa.array([len(s) for s in sets], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()), pa.array(sig, pa.binary()), pa.array(bits, pa.list_(pa.int64()))]
    halves = pa.array([s.astype(np.uint32).view(np.int32) if len(s) <= few else None for s in sets], pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([*columns, halves], ["node", "n", "set", "sig", "bits", "few"])


def _confirm(threshold: int):
    """Arrow batches of pairs with both sets and signatures: the pairs that link."""
    t = threshold / 100

    def confirm(batches):
        for batch in batches:
            keep = []
            col = {c: batch.column(c) for c in ("set_u", "set_v", "sig_u", "sig_v")}
            for i in range(batch.num_rows):
                su, sv = (np.frombuffer(col[c][i].as_buffer(), np.uint8) for c in ("sig_u", "sig_v"))
                if np.count_nonzero(su == sv) < len(su) * t - SIGMAS * np.sqrt(len(su) * t * (1 - t)):
                    keep.append(False)
                    continue
                a, b = (np.frombuffer(col[c][i].as_buffer(), "<u8") for c in ("set_u", "set_v"))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= threshold * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(keep, pa.bool_())], ["u", "v", "linked"])

    return confirm


def compare_sets(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(u, v, linked) for pairs (u, v). sets: (node, set, sig); sig holds the last byte of each minimum."""
    side = lambda x: sets.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("set", "sig")))
    return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "set_u", "set_v", "sig_u", "sig_v").mapInArrow(_confirm(threshold), "u long, v long, linked boolean")


def link(ws: Workspace, held: DataFrame, sets: DataFrame, stats: DataFrame, threshold: int, compare=compare_sets, words: int = 0, once: bool = True, met: DataFrame | None = None) -> DataFrame:
    """(node, root) of the components; threshold in hundredths. ``compare`` confirms pairs, as compare_sets does;
    ``words`` is the length of the signatures in ``bits`` of stats.

    With ``once`` a node carries its buckets, and a pair is compared in the least bucket that both share only: that
    bucket stays open until they are in one component or one of them has been its pivot. Without, for nodes in very
    many buckets, pairs that were compared are kept and left out; ``met`` then has all pairs of small buckets, which
    need not be in ``held``: the first round compares them.
    """
    able = stats.where(f"100 * (n - rare) >= {threshold} * n")
    kept = held.join(able, "node")
    # of two sets in a bucket the other one is no smaller than its least, and what is rare here is not in it
    least = kept.groupBy("bucket").agg(F.min("n").alias("least"))
    kept = ws.save(kept.join(least, "bucket").where(f"100 * (n - rare) >= {threshold} * (greatest(least, n - rare) + rare)").drop("least"), "able")
    if once:  # a node has as many buckets as there are bands at most
        kept = kept.join(kept.groupBy("node").agg(F.array_sort(F.collect_list("bucket")).alias("own")), "node")
    carried = ["bucket", "node", "n", "rare", *["own"] * once, *["bits", "few"] * bool(words)]
    members = ws.save(kept.select(*carried, F.col("node").alias("root")), "members-0")
    side = F.struct("rare", "node", "n", *["own"] * once, *["bits", "few"] * bool(words))
    bound = f"100 * least(n - rare, p.n - p.rare) >= {threshold} * greatest(n + p.rare, p.n + rare)"
    if words:
        bound += f" and {' + '.join(f'bit_count(bits[{i}] ^ p.bits[{i}])' for i in range(words))} <= {_bits_apart(threshold, 64 * words)}"
        # halves of shingles may be alike by chance: one more, at most, is taken to be in both
        bound += f" and (few is null or p.few is null or 100 * (size(array_intersect(few, p.few)) + 1) >= {threshold} * (n + p.n - size(array_intersect(few, p.few)) - 1))"
    if once:
        bound += " and bucket = array_min(array_intersect(own, p.own))"
    roots, tried, number = None, None, 0
    while True:
        if roots is None:
            pivots = members.groupBy("bucket").agg(F.count("*").alias("c"), F.min(side).alias("p")).where("c > 1").select("bucket", F.col("p.node").alias("pivot_root"), "p")  # the least edited
        else:
            by_root = members.groupBy("bucket", "root").agg(F.count("*").alias("c"))
            open_ = by_root.groupBy("bucket").agg(F.count("*").alias("roots"), F.max(F.struct("c", "root")).alias("largest"), F.sum("c").alias("c")).where("roots > 1")
            open_ = ws.save(open_.select("bucket", F.col("largest.root").alias("largest"), (F.col("c") - F.col("largest.c")).alias("others")), f"open-{number}")
            if open_.isEmpty():
                return roots
            drawn = f"root != largest and pmod(xxhash64(node), 1048576) * others < 1048576L * {4**number}"
            pivots = members.join(open_, "bucket").where(drawn).select("bucket", F.col("root").alias("pivot_root"), side.alias("p"))
        pivots = ws.save(pivots, f"pivots-{number}")
        meeting = members.join(pivots, "bucket").where(f"root != pivot_root and {bound}")
        pairs = meeting.select(F.least("node", "p.node").alias("u"), F.greatest("node", "p.node").alias("v"))
        pairs = (pairs if met is None or number else pairs.unionByName(met)).distinct()
        if not once:
            pairs = ws.save(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"), f"pairs-{number}")
            tried = pairs if tried is None else tried.unionByName(pairs)
        passed = ws.save(compare(pairs, sets, threshold).where("linked").select("u", "v"), f"linked-{number}")
        if roots is None:
            roots = merged = components(ws, passed, f"roots-{number}")
        else:
            root_of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
            contracted = passed.join(root_of("u"), "u", "left").join(root_of("v"), "v", "left").select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v"))
            merged = components(ws, contracted, f"roots-{number}")
            further = merged.select(F.col("node").alias("root"), F.col("root").alias("further"))
            roots = ws.save(roots.join(further, "root", "left").select("node", F.coalesce("further", "root").alias("root")).unionByName(merged), f"reached-{number}")
        still = members if number == 0 else members.join(open_, "bucket", "left_semi")
        still = still.join(pivots.select("bucket", F.col("p.node").alias("node")), ["bucket", "node"], "left_anti")
        further = merged.select(F.col("node").alias("root"), F.col("root").alias("further"))
        members = ws.save(still.join(further, "root", "left").select(*carried, F.coalesce("further", "root").alias("root")), f"members-{number + 1}")
        ws.drop(f"members-{number}", f"pivots-{number}", f"linked-{number}")
        number += 1
