import glob
import os
from collections import Counter

import duckdb
import pytest

from basalt.llm import queries as Q

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not glob.glob(f"{FOLDER}/*.parquet"), reason="no test tables")


@pytest.mark.parametrize("name", sorted(Q.QUERIES.keys() - Q.SQL.keys()))
def test_runs_twice_alike(spark, name):
    rows = [Counter(map(str, Q.QUERIES[name](spark, FOLDER).collect())) for _ in range(2)]
    assert rows[0] == rows[1] and rows[0]


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    df = Q.QUERIES[name](spark, FOLDER)
    r = c.execute(Q.SQL[name])
    assert Counter(map(tuple, df.collect())) == Counter(r.fetchall())
    assert df.columns == [x[0] for x in r.description]


def test_entry_lists_all_queries_of_this_subpackage():
    import __spark_entry__ as e

    assert Q.QUERIES.keys() <= e.queries().keys() and Q.SQL.keys() <= e.oracle_sql().keys()
