"""Every registered query next to its SQL, at the smallest scale."""

import pytest

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries
from tools.check import compare, oracle

SQL = oracle_sql()
NAMES = list(queries())


@pytest.fixture(scope="module")
def db():
    return oracle(SMOKE_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, db, name):
    _, rows, verdict = compare(spark, db, queries()[name], SQL.get(name), SMOKE_DIR)
    assert verdict in ("ok", "rows only"), verdict
    assert rows > 0


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(NAMES)


def test_entry(spark):
    assert entry(spark).columns[:4] == ["chart", "series", "x", "x_order"]
