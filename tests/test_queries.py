"""Every registered graph query against its SQL on the small tables."""

import glob
import os

import duckdb
import pytest

from hopflow.jobs import graph_queries
from tests.conftest import SF


def norm(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return float(x) if type(x).__name__ == "Decimal" else x


def table(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(columns), sorted((tuple(norm(r[k]) for k in at) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(graph_queries.ORACLES))
def test_query_matches_sql(spark, con, name):
    df = graph_queries.QUERIES[name](spark, SF)
    got = table(df.columns, df.collect())
    cursor = con.execute(graph_queries.ORACLES[name])
    want = table([d[0] for d in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
