"""Every registered query of the library runs, and where there is SQL DuckDB gives the same rows."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from lodestone.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def say(v):
        if isinstance(v, (float, np.floating)):
            return repr(round(float(v), 9))
        return "[" + ",".join(map(say, v)) + "]" if isinstance(v, (list, tuple)) else str(v)

    return sorted("|".join(say(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = canon([tuple(r) for r in df.collect()], df.columns)
    assert got
    if name in queries.SQL:
        r = duck.execute(queries.SQL[name])
        columns = [c[0] for c in r.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == canon(r.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
