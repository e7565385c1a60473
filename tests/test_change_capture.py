from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from factloom.functions.paths import plain_path
from factloom.operators import change_capture as C
from factloom.operators.change_capture import ChangeCapture, LogColumns, interval_of
from factloom.scratch import Scratch

def columns():
    return LogColumns(key=F.col("path"), version=F.nullif(F.lower("hash"), F.lit("")))


def at(minute):
    return dt.datetime(2026, 1, 1) + dt.timedelta(minutes=minute)


def micros(minute):
    return int((at(minute) - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000


def log(spark, entries):
    return spark.createDataFrame([(i, None if m is None else at(m), p, h, "x") for i, m, p, h in entries], "entry_id bigint, arrived_at timestamp, path string, hash string, key string")


@pytest.fixture
def capture(spark):
    return ChangeCapture(spark, Scratch(spark, "test").path("log"), partitions=4)


def run_all(capture):
    done = 0
    while n := capture.execute():
        done += n
    return done


RUNS = "run_id int, started_at timestamp, status string"


@pytest.mark.parametrize("at_once", [1, 2, 16])
def test_runs_see_each_change_once(spark, capture, rows, monkeypatch, at_once):
    monkeypatch.setattr(C, "RUNS", at_once)
    monkeypatch.setattr(C, "PLANNED", at_once)
    entries = log(spark, [(1, 1, "a", "H1"), (2, 2, "b", "h2"), (3, 11, "a", "h1"), (4, 12, "b", "h3"), (4, 12, "b", "h3"), (5, 13, "b", "h2"), (6, 21, "c", ""), (7, 21, "c", None), (8, 10, "d", "at"), (9, None, "e", "x"), (10, 1, None, "x"), (11, 99, "f", "late")])
    runs = spark.createDataFrame([(1, at(10), "ok"), (2, at(15), "failed"), (3, at(20), "ok"), (4, at(30), "ok"), (5, at(40), None), (6, None, "ok"), (None, at(3), "ok")], RUNS)
    capture.ingest(entries, columns())
    capture.plan_runs(runs, ok=F.col("status") == "ok")
    # The batch of run 2 is replayed by run 3; that of run 5 waits for a later run.
    assert run_all(capture) == 4 and [b.run_id for b in capture.pending()] == [5]
    # b went to h3 and back between runs 1 and 3; d arrived at the start of run 1, not before it.
    assert rows(capture.sink(), "run_id", "key") == [(1, "a"), (1, "b"), (3, "d")]
    capture.plan_runs(spark.createDataFrame([(7, at(100), "ok")], RUNS))
    assert run_all(capture) == 2
    assert rows(capture.sink().where("run_id > 3"), "run_id", "key") == [(7, "f")]


def test_every_partition_has_its_own_offsets(spark, capture, rows):
    capture.ingest(log(spark, [(i, i, f"k{i}", "1") for i in range(40)]), columns())
    capture.plan(1, micros(10))
    capture.plan(2, micros(25))
    one, two = capture.pending()
    assert len(set(one.until_seq)) > 1 and sum(one.until_seq) == 10
    assert one.from_seq == [0] * 4 and two.from_seq == one.until_seq and sum(two.until_seq) == 25
    run_all(capture)
    assert capture.sink().where("run_id = 1").count() == 10 and capture.sink().count() == 25


def test_ties_in_time_are_ordered_by_id(spark, capture, rows):
    capture.ingest(log(spark, [(2, 1, "a", "second"), (1, 1, "a", "first"), (2, 1, "a", "second")]), columns())
    capture.plan(7, micros(5))
    run_all(capture)
    assert rows(capture.state(), "key", "version") == [("a", "second")]


def test_a_crash_between_sink_and_commit_is_replayed_with_its_offsets(spark, capture, rows):
    capture.ingest(log(spark, [(1, 1, "a", "1"), (2, 2, "b", "1")]), columns())
    capture.plan(1, micros(5))
    planned = capture.plans()
    with pytest.raises(RuntimeError):
        capture.execute(fail=True)
    assert rows(capture.sink()) == [] and rows(capture.state()) == []
    # What comes in between lies behind the planned offsets, however early it arrived.
    capture.ingest(log(spark, [(3, 6, "a", "2"), (4, 1, "c", "early")]), columns())
    capture.plan(2, micros(10))
    assert capture.plans()[:1] == planned
    assert run_all(capture) == 2
    assert rows(capture.sink(), "run_id", "key", "version") == [(1, "a", "1"), (1, "b", "1"), (2, "a", "2"), (2, "c", "early")]
    assert capture.execute() == 0


def test_a_crash_in_a_later_pass_leaves_the_earlier_state(spark, capture, rows):
    capture.ingest(log(spark, [(1, 1, "a", "1"), (2, 2, "b", "1")]), columns())
    capture.plan(1, micros(5))
    run_all(capture)
    # Opened anew, with another number of partitions in mind: the first one stays.
    capture = ChangeCapture(spark, capture.root, partitions=9)
    assert capture.partitions == 4
    capture.ingest(log(spark, [(3, 6, "a", "2")]), columns())
    capture.plan(2, micros(10))
    with pytest.raises(RuntimeError):
        capture.execute(fail=True)
    assert rows(capture.state(), "key", "version") == [("a", "1"), ("b", "1")]
    run_all(capture)
    assert rows(capture.state(), "key", "version") == [("a", "2"), ("b", "1")]
    assert rows(capture.sink(), "run_id", "key") == [(1, "a"), (1, "b"), (2, "a")]


def test_late_records_go_to_the_next_run_and_never_undo_a_newer_state(spark, capture, rows):
    capture.ingest(log(spark, [(1, 1, "a", "1"), (2, 4, "b", "1"), (2, 4, "b", "1")]), columns())
    capture.plan(1, micros(5))
    run_all(capture)
    capture.ingest(log(spark, [(3, 7, "a", "1"), (4, 8, "b", "9"), (5, 8, "c", "1"), (6, 3, "z", "late"), (7, 2, "b", "late and old"), (1, 1, "a", "1")]), columns())
    capture.plan(2, micros(10))
    run_all(capture)
    assert rows(capture.sink().where("run_id = 2"), "key", "version") == [("b", "9"), ("c", "1"), ("z", "late")]
    capture.ingest(log(spark, [(8, 6, "b", "older still")]), columns())
    capture.plan(3, micros(20))
    run_all(capture)
    assert rows(capture.sink().where("run_id = 3")) == []
    assert rows(capture.state(), "key", "version") == [("a", "1"), ("b", "9"), ("c", "1"), ("z", "late")]


def test_a_later_run_reads_new_segments_and_touched_buckets_only(spark, rows):
    capture = ChangeCapture(spark, Scratch(spark, "test").path("log"), partitions=8)
    capture.ingest(log(spark, [(i, 1, f"k{i}", "1") for i in range(200)]), columns())
    capture.plan(1, micros(5))
    run_all(capture)
    capture.ingest(log(spark, [(500, 6, "k7", "2")]), columns())
    tail = capture._log(capture.plans()[-1].until_seq, capture.ends())
    assert all("segment=2" in f for f in tail.inputFiles())
    plan = tail._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(seq" in plan and "LessThan(seq" in plan
    capture.plan(2, micros(10))
    run_all(capture)
    manifest = capture._manifest()
    assert sorted(manifest.values()) == [1] * 7 + [2]
    assert capture.state().count() == 200 and rows(capture.state().where("key = 'k7'"), "version") == [("2",)]


def test_one_key_with_most_rows_and_an_empty_log(spark, capture, rows):
    many = spark.range(20_000).select(F.col("id").alias("entry_id"), (F.lit(at(0)) + F.make_dt_interval(secs=F.col("id"))).alias("arrived_at"), F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("hot").alias("path"), (F.col("id") % 2).cast("string").alias("hash"))
    capture.ingest(many, columns())
    sizes = capture.ends()
    assert len(sizes) == 4 and max(sizes) < 1.2 * min(sizes)
    capture.plan(1, micros(60 * 24))
    run_all(capture)
    assert capture.sink().count() == 6_667 + 1
    empty = ChangeCapture(spark, Scratch(spark, "test").path("log"), 2)
    empty.plan(1, micros(5))
    assert run_all(empty) == 1
    empty.ingest(many.limit(0), columns())
    empty.plan(2, micros(6))
    assert run_all(empty) == 1
    assert empty.sink().count() == 0 and empty.state().count() == 0
    empty.ingest(many.limit(5), columns())
    empty.plan(3, micros(60))
    run_all(empty)
    assert empty.sink().where("run_id = 3").count() > 0


def test_intervals_and_paths(spark, rows):
    df = spark.createDataFrame([(5,), (10,), (15,), (20,), (99,)], "v int")
    assert [r[0] for r in df.select(interval_of(F.col("v"), [F.lit(x) for x in (10, 10, 20, 30)])).collect()] == [0, 2, 2, 3, 3]
    paths = spark.createDataFrame([("./a/b",), (".\\a\\b",), ("a\\b",), ("././a",), (None,), ("",)], "p string")
    assert [r[0] for r in paths.select(plain_path(F.col("p"))).collect()] == ["a/b", "a/b", "a/b", "./a", None, ""]
