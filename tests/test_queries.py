import pytest

import __spark_entry__ as entry
from prefweave.plans.queries import ORACLE, QUERIES
from tests.oracle import connection, same


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, con):
    df = QUERIES[name](spark, data)
    if name in ORACLE:
        same(df, con, ORACLE[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 16384
    assert set(ORACLE) <= set(QUERIES)


def test_text_queries_see_every_text(spark, data, con):
    n = con.sql("select count(*) from documents where text is not null").fetchall()[0][0]
    assert [QUERIES[q](spark, data).count() for q in ("x12_strings", "x13_lines")] == [n, n]
