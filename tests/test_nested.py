from __future__ import annotations

import json

from factloom.operators.nested import COMPILER_FACTS, NestedTables, parse_object, visit


def _found(spark, payloads, rows):
    df = spark.createDataFrame(payloads, "oracle_id bigint, payload string, received_at int")
    return rows(NestedTables(df, "oracle_id", "payload", "received_at").links(), "record_id", "unit", "entity", "path", "parent_path", "name")


def test_levels_positions_and_parents(spark, rows):
    payload = {"files": {"a.kt": {"package": "p", "declarations": [None, {"fqn": "p.A", "members": {"name": "m", "params": [{"name": "x"}, None, {"type": "T"}]}}], "expressions": {"1:2": {"type": "Int"}, "3:4": None}, "diagnostics": {"factoryName": None}}, "b.kt": None, "": {}}}
    assert _found(spark, [(1, json.dumps(payload), 1)], rows) == sorted([
        (1, "a.kt", "file", "", "", "p"),
        (1, "", "file", "", "", ""),
        (1, "a.kt", "declaration", "declarations/1", "", "p.A"),
        (1, "a.kt", "member", "declarations/1/members/0", "declarations/1", "m"),
        (1, "a.kt", "param", "declarations/1/members/0/params/0", "declarations/1/members/0", "x"),
        (1, "a.kt", "param", "declarations/1/members/0/params/2", "declarations/1/members/0", ""),
        (1, "a.kt", "expression", "expressions/1:2", "", "1:2"),
        (1, "a.kt", "diagnostic", "diagnostics/0", "", ""),
    ], key=repr)


def test_what_is_not_one_object_gives_no_rows(spark, rows):
    bad = ["", "null", "[]", '"x"', "{", '{"files": {}} {}', '{"files": {"a": {}}} x', '{"files": NaN}', '{"files": []}', '{"files": null}', "{}", None]
    assert _found(spark, [(i, p, 0) for i, p in enumerate(bad)], rows) == []
    assert _found(spark, [], rows) == []


def test_a_record_delivered_twice_counts_once_and_the_newest_wins(spark, rows):
    first, second = '{"files": {"old": {}}}', '{"files": {"new": {}}}'
    got = _found(spark, [(1, first, 1), (1, second, 2), (1, second, 2), (2, first, None), (None, first, 1)], rows)
    assert [(r[0], r[1]) for r in got] == [(1, "new"), (2, "old"), (None, "old")]


def test_the_last_readable_delivery_counts(spark, rows):
    old, new = '{"files": {"old": {}}}', '{"files": {"new": {}}}'
    sent = [(1, old, 1), (1, new, 2), (1, new[:-1], 3), (1, "[]", 4), (2, "{", 1), (2, "", 2), (3, None, 5), (3, old, 1), (None, old, 1), (None, "{", 2), (4, new, 1)]
    assert [(r[0], r[1]) for r in _found(spark, sent, rows)] == [(1, "new"), (3, "old"), (4, "new"), (None, "old")]


def test_tables_have_their_own_schema_and_links(spark, rows):
    payload = {"files": {"f": {"declarations": [{"fqn": "A", "line": "7", "isData": "true", "supertypes": "B", "members": []}, {"fqn": 5, "line": 1.5}]}}}
    df = spark.createDataFrame([(1, json.dumps(payload), 1, "x", "y")], "oracle_id bigint, payload string, received_at int, tag string, record_id string")
    tables = NestedTables(df, "oracle_id", "payload", "received_at")
    assert rows(tables.table("declaration"), "fqn", "line", "isData", "supertypes") == [("5", None, None, None), ("A", 7, True, ["B"])]
    assert tables.table("member").count() == 0
    assert tables.table("param").columns[:5] == ["record_id", "unit", "path", "parent_path", "name"]
    empty = NestedTables(df.limit(0), "oracle_id", "payload", "received_at")
    assert empty.links().count() == 0


def test_very_long_records_and_odd_names(spark, rows):
    many = {"files": {"f": {"expressions": {f"{i}:1": {"type": "T" * 10} for i in range(30_000)}}, 'q"\\\n\t\u0000é😀': {}}}
    got = _found(spark, [(1, json.dumps(many), 1)], rows)
    assert len(got) == 30_002
    assert any(r[1] == 'q"\\\n\t\u0000é😀' for r in got)
    assert parse_object('{"a": "\\ud800"}') is not None
    seen = []
    visit(1, {"files": {"\ud800": {}}}, COMPILER_FACTS, lambda *row: seen.append(row))
    assert [r[2] for r in seen] == ["���"]
    assert parse_object("[" * 100_000) is None
