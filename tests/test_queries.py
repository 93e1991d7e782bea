"""Each kernel query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from sparkloom import code_queries, cursor_queries, index_queries, source_queries, stream_queries  # noqa: F401
from sparkloom.catalog_queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    number = lambda v: int(v) if isinstance(v, float) and v == int(v) else v
    return sorted(repr(tuple(map(number, r))) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(tuple(r[c] for c in columns) for r in got.collect()) == plain(want.select(*map(duckdb.ColumnExpression, columns)).fetchall())


def test_fuzzy_orders_by_closeness(spark):
    from sparkloom.functions.tokens import fuzzy_score

    assert fuzzy_score("SmallWidget", "smw") > fuzzy_score("SomeMallow", "smw") > 0
    assert fuzzy_score("bolt", "smw") == 0
    assert QUERIES["fuzzy_search"](spark, DATA).count() > 0
