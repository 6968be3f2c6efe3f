"""Every registered query of the rest of the library against its SQL.

EVENTIDE_SF=/root/testdata/sf0.1 names larger tables, where zero prices, empty arms and the like turn up more often.
"""

import math
import os

import duckdb
import pytest

from eventide.plans.all_queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


FOLDER = os.environ.get("EVENTIDE_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    rows = sorted([plain(x) for x in r] for r in df.select(*cols).collect())
    if name in ORACLE:
        rel = duck.sql(ORACLE[name])
        assert sorted(rel.columns) == cols
        order = [rel.columns.index(c) for c in cols]
        assert rows == sorted([plain(r[i]) for i in order] for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
