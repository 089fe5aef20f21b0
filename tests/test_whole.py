"""Queries that take all rows, where an older one of the same rule takes some."""

import datetime

from pyspark.sql import functions as F

from tidewheel.operators import health
from tidewheel.plans import queries as Q
from tidewheel.plans import views as V

DATA = "/root/testdata/sf0.001"


def test_epoch_of_all_events(spark, tmp_path):
    ids = [None, 0, 1, 89999, 90000, 90001, 99999, 100000, 7_776_000_000, 10**12 + 1]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    start, want = datetime.datetime(1970, 1, 1), {}
    for i in ids:
        s = (i or 0) % 90000 * 86400 + (i or 0) % 86400
        want[i] = f"{(start + datetime.timedelta(seconds=s)).isoformat()}+00:00" if s else None
    got = Q.QUERIES["scl17_epoch"](spark, str(tmp_path)).collect()
    assert len(got) == len(ids) and {r.event_id: r.posted for r in got} == want


def test_every_window(spark):
    """An id that goes missing and one that is extra in late windows; a board of two runs has no window."""
    seen = {"a": ["xyz", "xyz", "xyz", "xz", "xyzw", "xyz"], "b": ["x", "x"], "c": ["x", "y", "x"]}
    rows = [(board, 10 * n, i) for board, runs in seen.items() for n, ids in enumerate(runs) for i in ids]
    marks = health.window_marks(spark.createDataFrame([*rows, rows[0], ("a", None, "q")], "board string, run int, id string"), "board", "id", "run")
    got = {(r.board, r.run): (r.stable, r.missing, r.extra, r.verdict) for r in health.window_verdicts(marks, "board", "run").collect()}
    want = {}
    for board, runs in seen.items():
        for n in range(1, len(runs) - 1):
            b, p, a = (set(runs[n + k]) for k in (-1, 0, 1))
            counts = len(b & a), len((b & a) - p), len(p - b - a)
            want[board, 10 * n] = (*counts, "FAIL" if any(counts[1:]) else "PASS")
    assert got == want and want["a", 30] == (3, 1, 0, "FAIL") and want["a", 40] == (2, 0, 1, "FAIL")


def test_windows_grow_with_the_history(spark):
    boards = V.snapshots(spark, DATA).groupBy("company_id").agg(F.countDistinct("run").alias("n")).collect()
    assert Q.QUERIES["rcn04_window_verdict"](spark, DATA).count() == sum(max(b.n - 2, 0) for b in boards) > len(boards)
