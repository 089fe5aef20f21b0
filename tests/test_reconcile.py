from tidewheel.operators import reconcile


def test_passes(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 1, "y"), ("a", 2, "x"), ("a", 2, "z"), ("a", 2, None), ("b", 1, "q"), ("b", 2, "q"), ("c", 1, None)]
    got = {(r.company_id, r.run): tuple(r)[2:] for r in reconcile.pass_audit(spark.createDataFrame(rows, "company_id string, run int, external_id string")).collect()}
    assert got == {("a", 1): (3, 2, 1, 1, 2, 0, True), ("a", 2): (3, 2, 0, 0, 1, 1, True), ("b", 1): (1, 1, 0, 0, 1, 0, False), ("b", 2): (1, 1, 0, 0, 0, 0, False), ("c", 1): (1, 0, 0, 0, 0, 0, False)}


def test_attempts(spark):
    rows = [("a", 1, "html", 5, 9), ("a", 2, "greenhouse", 1, 2), ("a", 3, "smartrecruiters", 8, 8), ("b", 1, "html", 3, 6), ("b", 2, "auto", 3, 4), ("b", 3, "auto", 3, 4), ("c", 1, "greenhouse", 0, 0), ("c", 2, None, 0, 3), ("d", 1, "html", 0, 0)]
    got = {r.company_id: (r.attempt, r.trusted) for r in reconcile.best_of(spark.createDataFrame(rows, "company_id string, attempt int, kind string, usable long, rows long")).collect()}
    assert got == {"a": (2, True), "b": (2, False), "c": (2, False)}


def test_windows(spark):
    rows = [("ok", "1", True, True, True, True, True, True), ("ok", "2", False, True, None, None, False, False), ("wit", "1", False, False, True, True, None, None), ("txt", "1", True, True, True, False, True, False), ("miss", "1", True, False, True, False, False, False)]
    marks = spark.createDataFrame(rows, "board string, id string, before boolean, produced boolean, after boolean, witness boolean, in_target boolean, has_text boolean")
    got = {r.board: tuple(r)[1:] for r in reconcile.window_certificate(marks, ["board"]).collect()}
    assert got == {"ok": (1, 0, 1, 0, 1, 1, "CERTIFIED"), "wit": (0, 0, 0, 1, 0, 0, "FAILED"), "txt": (1, 0, 0, 0, 1, 0, "FAILED"), "miss": (1, 1, 0, 0, 0, 0, "FAILED")}
    assert {r.verdict for r in reconcile.window_certificate(marks, ["board"], marks.board == "none").collect()} == {"FAILED"}
