import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("THREADLOOM_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")

from threadloom.plans import registry  # noqa: E402


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for name in os.listdir(DATA):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return c


def value(v):
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None)
    return tuple(map(value, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    want = duck.execute(registry.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted((tuple(value(r[c]) for c in columns) for r in got.collect()), key=key) == sorted((tuple(map(value, r)) for r in want.fetchall()), key=key)


def test_every_query_has_its_sql():
    assert set(registry.QUERIES) == set(registry.SQL)
