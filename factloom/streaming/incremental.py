"""Structured Streaming: debounce, deduplication, incremental facts, running states.

Every operator gives the same rows as its batch counterpart over all that was
delivered; watermarks bound state only and are as wide as the caller says.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from factloom.control import Control
from factloom.operators.references import affected_set, overlay
from factloom.scratch import Scratch

# What a change of a file with this ending invalidates.
DOMAINS = {"kt": "source", "kts": "build", "java": "source", "xml": "resources", "gradle": "build", "toml": "build", "yml": "config", "yaml": "config", "editorconfig": "config"}


def file_stream(spark: SparkSession, folder: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def debounce(events: DataFrame, key: str = "path", at: str = "ts", gap: str = "50 milliseconds", late: str | None = None) -> DataFrame:
    """(key, start, stop, events): bursts of a key's events with gaps of ``gap`` at most, one row each."""
    source = events if late is None else events.withWatermark(at, late)
    return source.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "events")


def domains(events: DataFrame) -> DataFrame:
    """Events with the domain that they invalidate (``other`` for unknown endings)."""
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return events.withColumn("domain", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in DOMAINS.items() for x in p]), ending), F.lit("other")))


def domain_versions(events: DataFrame) -> DataFrame:
    """(domain, version): how often each domain was invalidated so far."""
    return domains(events).groupBy("domain").agg(F.count("*").alias("version"))


def once_each(events: DataFrame, id_: str = "id", at: str = "ts", late: str = "1 day") -> DataFrame:
    """Events with a new id only; ids are remembered for ``late`` beyond the newest event."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([id_])


def running_states(events: DataFrame) -> DataFrame:
    """(fp, n, first_ns, last_ns) so far; late events are always taken in (output mode complete or update)."""
    return events.groupBy("fp").agg(F.count("*").alias("n"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"))


class IncrementalIndex:
    """Symbols and references of the newest version of each file, kept up by micro-batches.

    Rows lie in buckets of their file's hash, and a batch rewrites only the
    buckets of the files it changed. When these are written, a pointer (batch,
    and for each table the batch that holds each bucket) is put beside them; a
    batch that broke off before is written again, one that is done is passed
    over. An index opened at the same ``root`` goes on from the last pointer.
    ``affected`` gives the files that a batch made stale, over the versions
    before and after it. ``schemas`` are those of the two tables, each with a
    column ``file``.
    """

    TABLES = ("symbols", "refs")

    def __init__(self, spark: SparkSession, schemas: tuple[str, str] = ("file string, name string", "file string, name string"), root: str | None = None, buckets: int = 16):
        self.spark, self.schemas = spark, dict(zip(self.TABLES, schemas))
        self.root = (root or Scratch(spark, "index").root).rstrip("/")
        self.control = Control(spark, self.root)
        self.buckets = self._pointer().get("buckets", buckets)

    def _pointer(self) -> dict:
        done = self.control.numbers("pointers")
        return self.control.get("pointers", done[-1]) if done else {}

    @property
    def version(self) -> int | None:
        """The last batch taken in."""
        return max(self.control.numbers("pointers"), default=None)

    def _rows(self, table: str, held: dict[str, int]) -> DataFrame:
        empty = self.spark.createDataFrame([], self.schemas[table])
        paths = [f"{self.root}/{table}/batch={n}/bucket={b}" for b, n in held.items() if self.control.exists(f"{table}/batch={n}/bucket={b}")]
        return self.spark.read.schema(self.schemas[table]).option("basePath", f"{self.root}/{table}").parquet(*paths).select(empty.columns) if paths else empty

    def table(self, name: str) -> DataFrame:
        return self._rows(name, self._pointer().get(name, {}))

    @property
    def symbols(self) -> DataFrame:
        return self.table("symbols")

    @property
    def refs(self) -> DataFrame:
        return self.table("refs")

    def affected(self, batch_id: int) -> DataFrame:
        return self.spark.read.schema("file string").parquet(f"{self.root}/affected/batch={batch_id}")

    def apply(self, batch_id: int, changed: DataFrame, symbols: DataFrame, refs: DataFrame) -> None:
        """Take in the fresh rows of the changed files (file); a changed file without rows is gone."""
        if self.version is not None and batch_id <= self.version:
            return
        bucket = F.pmod(F.xxhash64("file"), F.lit(self.buckets)).cast("int").alias("bucket")
        fresh = {"symbols": symbols, "refs": refs}
        seen = changed.select("file")
        for df in fresh.values():
            seen = seen.unionByName(df.select("file"))
        # As many as buckets.
        touched = [str(r[0]) for r in seen.select(bucket).distinct().collect()]
        before, after = self._pointer(), {"buckets": self.buckets}
        for name in self.TABLES:
            held = before.get(name, {})
            kept = overlay(self._rows(name, {b: n for b, n in held.items() if b in touched}), changed, fresh[name])
            kept.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{name}/batch={batch_id}")
            after[name] = held | dict.fromkeys(touched, batch_id)
        versions = [tuple(self._rows(name, pointer.get(name, {})) for name in self.TABLES) for pointer in (before, after)]
        affected_set(changed, versions).write.mode("overwrite").parquet(f"{self.root}/affected/batch={batch_id}")
        self.control.put("pointers", batch_id, after)

    def writer(self, split: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]]) -> Callable[[DataFrame, int], None]:
        """A function for ``foreachBatch``; ``split`` gives (changed, symbols, refs) of a micro-batch."""
        return lambda df, batch_id: self.apply(batch_id, *split(df))


def replay(cached: DataFrame, affected: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Findings of unaffected files from the cache and those of affected ones anew."""
    return cached.join(affected.select("file").distinct(), "file", "left_anti").unionByName(recomputed.join(affected.select("file").distinct(), "file", "left_semi"))


def idle_keys(events: DataFrame, key: str = "path", at: str = "ts", idle: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, since, events): stretches of a key's use that ended by ``idle`` without an event; their state is dropped then."""
    return debounce(events, key, at, idle, late).select(key, F.col("stop").alias("since"), "events")


def stream_rows(df: DataFrame, columns: list[str] | None = None) -> Iterator[dict]:
    """Rows one by one as they are asked for; only the partition being read is on the driver."""
    for row in (df.select(*columns) if columns else df).toLocalIterator(prefetchPartitions=True):
        yield row.asDict(recursive=True)


class Progress(StreamingQueryListener):
    """Keeps the last progress of each query by its name: batch, rows in, rows a second."""

    def __init__(self) -> None:
        self.last: dict[str, dict] = {}
        self.ended: dict[str, str | None] = {}
        self._names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self._names[str(event.id)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = p.name or str(p.id)
        self.last[name] = {"batch": p.batchId, "rows": self.last.get(name, {}).get("rows", 0) + p.numInputRows, "per_second": p.processedRowsPerSecond}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[self._names.get(str(event.id), str(event.id))] = event.exception


def drain(stream: DataFrame, label: str = "drain", mode: str = "append") -> DataFrame:
    """Run a stream over what there is and give its result as a table in the shared folder.

    Every batch replaces its own folder, so one that is run again counts once.
    With mode ``complete`` the result is that of the last batch.
    """
    scratch, spark = Scratch(stream.sparkSession, label), stream.sparkSession

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(scratch.path(f"out/batch={batch_id}"))

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", scratch.path("state")).trigger(availableNow=True).start()
    q.awaitTermination()
    names = Control(spark, scratch.root).names("out")
    if not names:
        return spark.createDataFrame([], stream.schema)
    kept = sorted(names, key=lambda n: int(n.split("=")[1]))
    kept = kept[-1:] if mode == "complete" else kept
    return spark.read.schema(stream.schema).parquet(*[scratch.path(f"out/{n}") for n in kept]) if len(kept) == 1 else spark.read.schema(stream.schema).option("basePath", scratch.path("out")).parquet(*[scratch.path(f"out/{n}") for n in kept]).select(stream.columns)
