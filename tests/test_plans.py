"""What plans must not hold, and what must reach the scan."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.compare import SMALL

pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the test tables")
LAZY = ["ag1_reference_aggregate", "ag5_symbol_fan_in", "ag25_below_maximum", "jo3_resolve_types", "jo7_unused_symbols", "jo13_unsuppressed", "jo15_baseline", "jo25_reconcile", "pf7_has_ancestor", "pf25_on_changed_lines", "pf30_file_to_module", "so10_lru_evict", "ud5_pattern_rules"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_join_of_all_pairs_and_no_row_at_a_time_python(spark, name):
    text = plan(entry.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text and "BatchEvalPython" not in text


def test_scans_read_what_the_query_needs(spark):
    text = plan(entry.queries()["p4_found"](spark, SMALL))
    schema = {line.split("ReadSchema: ")[1].split(">")[0] for line in text.splitlines() if "ReadSchema: " in line}
    assert all("confidence" not in s and "severity" not in s for s in schema)
    found = plan(entry.queries()["ag2_reference_count"](spark, SMALL))
    assert "l_extendedprice" not in found.split("ReadSchema: ")[1].split("\n")[0]
