from __future__ import annotations

from pathlib import Path

import pytest

from factloom.llm.queries import QUERIES, SQL
from tests.compare import SMALL, duck, same

pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    same(spark, duck(), QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    QUERIES[name](spark, SMALL).count()
