from tidewheel.operators import canonical

ROW = "company_id string, site string, ord int, external_id string, title string, location string, job_url string"
BOARD = "company_id string, tenant string, base string, locale string"


def test_seven_sites(spark):
    rows = [
        ("p", "phenom", 1, "x", "A", None, "https://c.example/us/en/job/77-a/cook?x=1"), ("p", "phenom", 2, "12345678", "B", None, None), ("p", "phenom", 3, "short", "C", None, None), ("p", "phenom", 4, "short", "D", None, "https://c.example/d"), ("p", "phenom", 5, "12345678", "E", None, "https://cdn.phenompeople.com/e"),
        ("g", "goldman", 6, "z", "A", None, "https://x.gs.com/roles/55?y"), ("g", "goldman", 7, "66", "B", None, "https://x.gs.com/about"), ("g", "goldman", 8, "abc", "C", None, "https://x.gs.com/about"),
        ("a", "atlassian", 9, None, "A", None, "https://h/company/careers/details/9"), ("t", "trakstar", 10, "1", "A", None, "https://t.example/jobs/fk0_a-1/"), ("t", "trakstar", 11, "11", "B", None, "https://t.example/about"),
        ("k", "kula", 12, None, "A", None, "https://careers.kula.ai/Acme/jobs/12"), ("k", "kula", 13, "own", "B", None, "https://careers.kula.ai/acme/13/apply"), ("k", "kula", 14, "r", "C", None, "https://careers.kula.ai/rival/14"), ("k", "kula", 15, None, "D", None, None),
        ("v", "avature", 16, "q", "A", None, "https://i.example/careers/JobDetail/Cook/16"), ("v", "avature", 17, "q", "B", None, "https://i.example/x?a=1&jobId=17&b"), ("v", "avature", 18, "18", "C", None, None), ("v", "avature", 19, "q19", "D", None, "https://i.example/x"),
        ("e", "eightfold", 20, "own", "A", None, "https://t.eightfold.ai/careers/job/20"), ("e", "eightfold", 21, None, "B", None, "https://c.example/careers/job/21"), ("n", "none", 22, "x", "A", None, "u"),
        ("g", "goldman", 23, "55", "a", None, "https://y.gs.com/roles/55"),
    ]
    boards = [("p", None, "https://c.example", None), ("k", "ACME", None, None), ("v", None, None, "de_DE"), ("e", None, "https://c.example/", None)]
    found = canonical.canonicalize(spark.createDataFrame(rows, ROW), canonical.canonical_rules(spark), spark.createDataFrame(boards, BOARD))
    assert found.columns == [c.split()[0] for c in ROW.split(", ")]
    assert {r.ord: (r.external_id, r.job_url) for r in found.collect()} == {
        1: ("77-a", "https://c.example/us/en/job/77-a/cook?x=1"), 2: ("12345678", None), 4: ("short", "https://c.example/d"),
        6: ("55", "https://higher.gs.com/roles/55"), 7: ("66", "https://higher.gs.com/roles/66"), 9: ("9", "https://www.atlassian.com/company/careers/details/9"), 10: ("fk0_a-1", "https://t.example/jobs/fk0_a-1/"),
        12: ("12", "https://careers.kula.ai/acme/12"), 13: ("own", "https://careers.kula.ai/acme/13"), 14: ("r", "https://careers.kula.ai/rival/14"), 15: (None, None),
        16: ("16", "https://i.example/careers/JobDetail/Cook/16"), 17: ("17", "https://i.example/x?a=1&jobId=17&b"), 18: ("18", "https://careers.ibm.com/de_DE/careers/JobDetail?jobId=18"),
        20: ("own", "https://c.example/careers/job/20"), 21: (None, "https://c.example/careers/job/21"), 22: ("x", "u"),
    }


def test_without_boards_and_rows(spark):
    rules = canonical.canonical_rules(spark)
    rows = spark.createDataFrame([("k", "kula", 1, None, "A", None, "https://careers.kula.ai/any/5"), ("e", "eightfold", 2, "o", "B", None, "https://t.eightfold.ai/careers/job/2"), ("p", "phenom", 3, "12345678", "E", None, "https://cdn.phenompeople.com/e")], ROW)
    got = {r.ord: (r.external_id, r.job_url) for r in canonical.canonicalize(rows, rules).collect()}
    assert got == {1: ("5", "https://careers.kula.ai/any/5"), 2: ("o", "https://t.eightfold.ai/careers/job/2"), 3: ("12345678", "https://cdn.phenompeople.com/e")}
    assert canonical.canonicalize(rows.limit(0), rules).isEmpty()
