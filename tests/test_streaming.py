from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import functions as F

from factloom.operators.references import affected_set
from factloom.streaming import incremental as I


def at(ms):
    return dt.datetime(2026, 1, 1) + dt.timedelta(milliseconds=ms)


def write(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_debounce_batch_and_stream_agree(spark, tmp_path, rows):
    schema = "path string, ts timestamp"
    data = [("a", at(0)), ("a", at(30)), ("a", at(79)), ("a", at(130)), ("b", at(10)), ("a", at(500))]
    write(spark, tmp_path / "e", data, schema)
    batch = I.debounce(spark.read.parquet(str(tmp_path / "e")))
    assert sorted((r[0], r[3]) for r in rows(batch)) == [("a", 1), ("a", 1), ("a", 3), ("b", 1)]
    stream = I.debounce(I.file_stream(spark, str(tmp_path / "e"), schema), late="1 hour")
    assert rows(I.drain(stream, mode="complete")) == rows(batch)


def test_domains_and_once_each(spark, tmp_path, rows):
    df = spark.createDataFrame([("a.kt",), ("b.java",), ("x.XML",), ("Makefile",)], "path string")
    assert rows(I.domain_versions(df)) == [("other", 1), ("resources", 1), ("source", 2)]
    schema = "id string, ts timestamp"
    write(spark, tmp_path / "e", [("1", at(0)), ("1", at(5)), ("2", at(9))], schema)
    write(spark, tmp_path / "e", [("2", at(20)), ("3", at(21))], schema)
    stream = I.once_each(I.file_stream(spark, str(tmp_path / "e"), schema, 1))
    assert rows(I.drain(stream), "id") == [("1",), ("2",), ("3",)]


def test_index_kept_by_batches_equals_the_last_versions(spark, tmp_path, rows):
    schema = "file string, kind string, name string"
    versions = [[("f", "symbol", "A"), ("f", "ref", "B"), ("g", "symbol", "B"), ("h", "ref", "A")], [("f", "symbol", "C"), ("h", "ref", "C")], [("f", "gone", "")]]
    for v in versions:
        write(spark, tmp_path / "v", v, schema)
    root = f"file://{tmp_path}/index"
    index = I.IncrementalIndex(spark, root=root, buckets=4)

    def split(df):
        return df.select("file").distinct(), df.where("kind = 'symbol'").select("file", "name"), df.where("kind = 'ref'").select("file", "name")

    q = I.file_stream(spark, str(tmp_path / "v"), schema, 1).writeStream.foreachBatch(index.writer(split)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(index.symbols) == [("g", "B")] and rows(index.refs) == [("h", "C")]
    # Removing C from f touches h, which refers to it only in the version before.
    assert rows(index.affected(2)) == [("f",), ("h",)]
    index.apply(2, index.symbols, index.symbols, index.symbols)
    assert rows(index.symbols) == [("g", "B")]
    # Opened anew, as after a restart, it goes on from the pointer.
    again = I.IncrementalIndex(spark, root=root, buckets=9)
    assert again.version == 2 and again.buckets == 4 and rows(again.refs) == [("h", "C")]
    frame = lambda x: spark.createDataFrame(x, "file string, name string")
    again.apply(3, spark.createDataFrame([("g",)], "file string"), frame([("g", "D")]), frame([]))
    assert rows(again.symbols) == [("g", "D")] and rows(again.affected(3)) == [("g",)]
    # Only the bucket of g was written.
    held = again._pointer()["symbols"]
    assert sorted(held.values()).count(3) == 1


def test_idle_keys_streamed_rows_and_progress(spark, tmp_path, rows):
    schema = "path string, ts timestamp"
    write(spark, tmp_path / "e", [("a", at(0)), ("a", at(60_000)), ("b", at(10)), ("a", at(9_000_000))], schema)
    assert sorted(r[::2] for r in rows(I.idle_keys(spark.read.parquet(str(tmp_path / "e"))))) == [("a", 1), ("a", 2), ("b", 1)]
    assert [r["id"] for r in I.stream_rows(spark.range(0, 50, 1, 5), ["id"])] == list(range(50))
    progress = I.Progress()
    spark.streams.addListener(progress)
    try:
        q = I.file_stream(spark, str(tmp_path / "e"), schema).writeStream.queryName("watched").format("noop").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
        q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(100):
            if "watched" in progress.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(progress)
    assert progress.last["watched"]["rows"] == 4 and progress.ended["watched"] is None


def test_affected_set_sees_removed_contributions(spark, rows):
    frame = lambda x: spark.createDataFrame(x, "file string, name string")
    changed = spark.createDataFrame([("f",)], "file string")
    old, new = (frame([("f", "A"), ("k", "K")]), frame([("g", "A"), ("f", "K")])), (frame([("k", "K")]), frame([("g", "A")]))
    assert rows(affected_set(changed, [old, new])) == [("f",), ("g",), ("k",)]
    assert rows(affected_set(changed, [new])) == [("f",)]


def test_replay_and_running_states(spark, rows):
    frame = lambda x: spark.createDataFrame(x, "file string, v int")
    assert rows(I.replay(frame([("a", 1), ("b", 1)]), frame([("b", 0)]), frame([("b", 2), ("a", 9)]))) == [("a", 1), ("b", 2)]
    e = spark.createDataFrame([("x", 5), ("x", 2)], "fp string, timestamp_ns bigint")
    assert rows(I.running_states(e)) == [("x", 2, 2, 5)]
    assert I.running_states(e.where(F.lit(False))).count() == 0
