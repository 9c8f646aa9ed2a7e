import pytest

from prefweave.llm import queries
from prefweave.llm.mixing import mixed
from prefweave.llm.oracle import ORACLE
from prefweave.llm.queries import QUERIES
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


def test_p3_found_mixes(spark, data, monkeypatch):
    calls = []
    monkeypatch.setattr(queries, "mixed", lambda *a, **k: calls.append(a) or mixed(*a, **k))
    found = {tuple(r) for r in QUERIES["p3_found"](spark, data).collect()}
    report = [((r["mix_id"], r["kind"], r["source"]), r["wanted"] - r["drawn"]) for r in QUERIES["p3_report"](spark, data).collect()]
    # a met target is drawn as the next whole number
    assert calls and {k for k, gap in report if gap > 0.5} <= found <= {k for k, gap in report if gap > 0}
