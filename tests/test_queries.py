"""Every registered query outside the llm subpackage: against its SQL, or at least that it runs."""

from __future__ import annotations

import importlib
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.compare import SMALL, duck, same

QUERIES, SQL = {}, {}
for name in entry._MODULES:
    module = importlib.import_module(name)
    QUERIES.update(module.QUERIES)
    SQL.update(module.SQL)

pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    same(spark, con, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    # Collected, so that no column is pruned away.
    QUERIES[name](spark, SMALL).collect()


def test_entry_has_rows_and_every_sql_a_query(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
