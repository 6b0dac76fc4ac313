"""Every query with SQL against DuckDB on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from gleanbin.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
HEAVY = {"liveness_fixpoint", "taint_fixpoint", "constants_fixpoint"}


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(smallest):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{smallest}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, duck, smallest, name):
    df = queries.QUERIES[name](spark, smallest)
    columns = sorted(df.columns)
    want = duck.sql(queries.ORACLES[name])
    assert sorted(want.columns) == columns
    order = [list(want.columns).index(c) for c in columns]
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == Counter(tuple(plain(r[k]) for k in order) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_runs(spark, smallest, name):
    assert queries.QUERIES[name](spark, smallest).count() > 0


def test_entry_point_lists_every_query():
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
