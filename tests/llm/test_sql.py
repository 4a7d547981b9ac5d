import os

import duckdb
import pytest

from threadloom import llm

DATA = os.environ.get("THREADLOOM_TESTDATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for file in os.listdir(DATA):
        c.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{file}')")
    want = c.execute(llm.SQL[name])
    columns = [d[0] for d in want.description]
    got = llm.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r[x] for x in columns) for r in got.collect()) == sorted(want.fetchall())
