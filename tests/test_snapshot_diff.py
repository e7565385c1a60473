from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators.snapshot_diff import diff_snapshots

SCHEMA = "snapshot_id int, captured_at int, delivered_at int, rule string, file string, line int, message string, change string, seq string"


def key():
    return {"rule": F.col("rule"), "file": F.col("file"), "line": F.coalesce(F.col("line"), F.lit(0))}


def diff(spark, data):
    return diff_snapshots(spark.createDataFrame([(*r, "x", "y") for r in data], SCHEMA), key(), [F.coalesce(F.col("message"), F.lit(""))])


def test_added_removed_changed_by_time_of_capture(spark, rows):
    data = [
        (9, 1, 1, "r", "f", 1, "a"), (9, 1, 1, "r", "f", 2, None), (9, 1, 1, "r", "g", None, "m"),
        (3, 2, 2, "r", "f", 1, "b"), (3, 2, 2, "r", "f", 2, ""), (3, 2, 2, "r", "h", 0, "m"),
        (5, 3, 3, "r", "f", 1, "b"), (5, 3, 3, "r", "f", 1, "b"),
    ]
    assert rows(diff(spark, data), "snapshot_id", "change", "rule", "file", "line") == [
        (3, "added", "r", "h", 0), (3, "changed", "r", "f", 1), (3, "removed", "r", "g", 0),
        (5, "removed", "r", "f", 2), (5, "removed", "r", "h", 0),
    ]


def test_nulls_repeats_and_ties(spark, rows):
    data = [
        (1, 1, 1, None, "f", 1, "a"), (1, 1, 1, "r", None, 1, "a"), (None, 1, 1, "r", "f", 1, "a"),
        (1, 1, 1, "r", "f", 1, "old"), (1, 1, 2, "r", "f", 1, "new"), (1, 1, None, "r", "f", 1, "undated"),
        (2, 2, 1, "r", "f", 1, "new"), (2, 2, 1, "r", "f", 1, "new"),
    ]
    assert rows(diff(spark, data)) == []
    tied = [(1, 1, 1, "r", "f", 1, "x"), (1, 1, 1, "r", "f", 1, "y"), (2, 2, 1, "r", "f", 1, "y"), (2, 2, 1, "r", "f", 1, "x")]
    assert rows(diff(spark, tied)) == []


def test_empty_and_single_snapshots(spark, rows):
    assert rows(diff(spark, [])) == []
    assert rows(diff(spark, [(1, 1, 1, "r", "f", 1, "a")])) == []


def test_one_key_in_most_rows(spark, rows):
    hot = spark.range(30_000).select((F.col("id") % 2).cast("int").alias("snapshot_id"), (F.col("id") % 2).cast("int").alias("captured_at"), F.col("id").cast("int").alias("delivered_at"), F.lit("r").alias("rule"), F.lit("f").alias("file"), F.lit(1).alias("line"), (F.col("id") % 2).cast("string").alias("message"))
    assert rows(diff_snapshots(hot, key(), [F.col("message")])) == [(1, "changed", "r", "f", 1)]
