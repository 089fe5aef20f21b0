"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

import tidewheel.plans.artifacts  # noqa: F401
import tidewheel.plans.boards  # noqa: F401
import tidewheel.plans.history  # noqa: F401
import tidewheel.plans.reports  # noqa: F401
import tidewheel.plans.site_pages  # noqa: F401
from tidewheel.plans import queries as Q

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_against_sql(spark, duck, name):
    found = Q.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    result = duck.execute(Q.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [[r[names.index(c)] for c in columns] for r in result.fetchall()]
    assert plain(want) == plain([[r[c] for c in columns] for r in found.collect()])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE)))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, DATA).collect() is not None
