"""Every registered query against its DuckDB twin, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from queries import ALL
from conftest import SF_DIR
from oracle import compare, connect

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, duck, name):
    verdict, _ = compare(spark, duck, SF_DIR, entry.queries()[name], SQL.get(name))
    assert verdict in ("same", "rows only")


def test_entry(spark):
    stats = entry.entry(spark)
    assert stats.count() == 6


def test_every_twin_has_a_query():
    assert set(SQL) <= set(entry.queries())
