"""Every registered query that has an SQL check, on the smallest tables."""

import duckdb
import pytest

from catalog.oracles import LONG, ORACLES
from catalog.registry import QUERIES
from tests.conftest import SMALL
from tools.check import TABLES, rows


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in ORACLES if n not in LONG])
def test_query_equals_sql(spark, db, name):
    got_types, got = rows(QUERIES[name](spark, SMALL).toArrow())
    want_types, want = rows(db.sql(ORACLES[name]).to_arrow_table())
    assert got_types == want_types
    assert got == want
