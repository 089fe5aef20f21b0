import os
import random

import pytest

from tidewheel.streaming import merge as streaming

SCHEMA = "run int, company_id string, external_id string, content string"
COLUMNS = ("content_hash", "first_seen", "last_seen", "changed_at", "active", "last_change_type")


def merged(runs, state=None):
    """The state by merging one run after another, as a plain loop: {(company, id): list of COLUMNS}."""
    state = {k: list(v) for k, v in (state or {}).items()}
    for run, rows in sorted(runs.items()):
        for company in {c for c, _, _ in rows}:
            found = {i: text for c, i, text in rows if c == company}
            had = sum(v[4] for (c, _), v in state.items() if c == company)
            complete = not (had > 0 and len(found) < had * (1 - 0.8))
            for i, text in found.items():
                old = state.get((company, i))
                change = "new" if old is None else "changed" if old[0] != text else "unchanged"
                state[company, i] = [text, old[1] if old else str(run), str(run), str(run) if change != "unchanged" else old[3], True, change]
            if complete:
                for (c, i), v in state.items():
                    if c == company and i not in found:
                        v[4] = False
    return state


def made(rng, first, n):
    """Runs of three companies that drop, lose nearly all and reappear."""
    runs = {}
    for run in range(first, first + n):
        rows = []
        for company, size in (("a", 12), ("b", 3), ("c", 30)):
            if rng.random() < 0.85:
                share = rng.choice([1.0, 0.9, 0.5, 0.1, 0.05])
                rows += [(company, f"{company}{i}", rng.choice("xyz")) for i in range(size) if rng.random() < share]
        runs[run] = rows
    return runs


def table(spark, runs):
    return spark.createDataFrame([(run, *row) for run, rows in runs.items() for row in rows], SCHEMA)


def held(df):
    return {(r.company_id, r.external_id): [r[c] for c in COLUMNS] for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_all_runs_of_a_batch_in_one_plan(spark, seed):
    """Thirty runs at once equal a loop over them; so do thirty more on top of the state."""
    rng = random.Random(seed)
    first, second = made(rng, 0, 30), made(rng, 30, 30)
    state = streaming.merge_runs(spark.createDataFrame([], streaming.STATE), table(spark, first))
    assert held(state) == merged(first)
    again = spark.createDataFrame([(*k, *v) for k, v in merged(first).items()], streaming.STATE)
    assert held(streaming.merge_runs(again, table(spark, second))) == merged(second, merged(first))


def test_odd_rows(spark):
    """Repeated rows, null contents, rows without a key, an empty batch."""
    rows = [(1, "a", "k", "x"), (1, "a", "k", "x"), (1, "a", "k", "b"), (1, None, "k", "x"), (1, "a", None, "x"), (None, "a", "z", "x"), (2, "a", "k", None)]
    state = streaming.merge_runs(spark.createDataFrame([], streaming.STATE), spark.createDataFrame(rows, SCHEMA))
    assert held(state) == {("a", "k"): ["", "1", "2", "2", True, "changed"]}
    kept = spark.createDataFrame([("a", "k", "x", "1", "1", "1", True, "new")], streaming.STATE)
    assert held(streaming.merge_runs(kept, spark.createDataFrame([], SCHEMA))) == held(kept)


def test_stream_rewrites_touched_buckets_and_drops_old_ones(spark, tmp_path):
    rng, root, total = random.Random(9), f"{tmp_path}/state", {}
    for n in range(5):
        runs = made(rng, 10 * n, 3)
        if n in (2, 3, 4):  # only one company comes
            runs = {k: [r for r in rows if r[0] == "a"] or [("a", "a0", "x")] for k, rows in runs.items()}
        total |= runs
        table(spark, runs).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        streaming.start(spark, f"{tmp_path}/in", SCHEMA, root, f"{tmp_path}/cp").awaitTermination()
        assert held(streaming.state(spark, root)) == merged(total)
    manifest = streaming.Store(spark, root).manifest(4)
    buckets = {n: {x for x in os.listdir(f"{root}/state/{n}") if x.startswith("bucket=")} for n in os.listdir(f"{root}/state")}
    assert len(set(manifest.values())) == 2 and manifest[next(k for k, b in manifest.items() if b == 4)] == 4
    assert len(buckets["batch=4"]) == 1 and sum(map(len, buckets.values())) == len(manifest) + 1
    assert streaming.Store(spark, root).batches() == [3, 4]


def test_a_batch_counts_once_and_only_with_its_manifest(spark, tmp_path):
    root, apply = f"{tmp_path}/state", streaming.merge_batch(f"{tmp_path}/state")
    first, second = {0: [("a", "k", "x"), ("b", "k", "x")]}, {1: [("a", "k", "y")]}
    apply(table(spark, first), 0)
    apply(table(spark, second), 0)  # batch 0 is done
    assert held(streaming.state(spark, root)) == merged(first)
    # a batch that ended before its manifest was written
    streaming.merge_runs(spark.createDataFrame([], streaming.STATE), table(spark, {7: [("a", "q", "z")]})).withColumn("bucket", streaming.bucket_of(streaming.F.col("company_id"))).write.partitionBy("bucket").parquet(f"{root}/state/batch=1")
    assert held(streaming.state(spark, root)) == merged(first)
    apply(table(spark, second), 1)
    assert held(streaming.state(spark, root)) == merged(first | second)
