from pyspark.sql import functions as F

from tidewheel.plans import views as V


def test_page_log_numbers_rows_without_a_window_over_a_board(spark):
    sf = "/root/testdata/sf0.001"
    log = V.page_log(spark, sf)
    plan = log._jdf.queryExecution().toString()
    assert "row_number" not in plan
    keys = {}
    for r in V.read(spark, sf, "orders").orderBy("o_orderkey").collect():
        keys.setdefault(r.o_custkey % 10, []).append(r.o_orderkey)
    want = sorted((b, p // 10, k, len(ks)) for b, ks in keys.items() for p, k in enumerate(ks) if p // 10 % 17 != 5 and p // 10 % 23 != 7)
    got = log.where((F.col("page_no") < 100000) & F.col("external_id").isNotNull()).select("board", "page_no", "external_id", "total")
    assert sorted(tuple(r) for r in got.collect()) == want
