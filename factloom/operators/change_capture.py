"""Problem 3: processing only new or changed records.

Records are appended to a log of partitions. A partition is filled by a hash of
the record, so no key makes one large, and each record gets the next offset of
its partition when it comes in. Runs capture the log in batches. A batch is
planned first and its plan written ahead: for every partition the offsets
[from, until) it covers, ``until`` being the first offset whose record had not
arrived when the run started. A record that comes in late has a later offset
than everything before it, so the next run takes it: nothing is skipped, and
the arrival times decide only which state of a key is the newest.

A planned batch that was not committed is replayed with exactly its written
offsets before anything later, be it after a crash or, where the run itself
failed for good, as part of the next run that succeeds. Changes go to a sink in
which a (key, offset) counts once. The newest state of the keys is kept in
buckets of the key's hash, and a pass rewrites only the buckets it touches.

What grows with the records lies in tables: ``log`` (one folder per segment
taken in) and ``passes`` (sink rows and states that a pass wrote, replaced when
it is replayed). What steers them is a few numbers for each partition, kept as
small JSON files that appear at once or not at all: ``ends`` (the offsets that
a segment reaches), ``plans`` and ``commits`` (the pass that holds each bucket).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from factloom.control import Control
from factloom.scratch import delete

LOG = "part int, seq bigint, key string, version string, arrived_us bigint, record_id bigint, bucket int"
STATE = "bucket int, key string, version string, arrived_us bigint, record_id bigint, part int, seq bigint"
CHANGE = "batch_id bigint, run_id int, key string, version string, arrived_us bigint, record_id bigint, part int, seq bigint"
#: Successful runs that one pass over the log captures.
RUNS = 16
#: Runs that are planned by one scan of arrival times.
PLANNED = 64


@dataclass(frozen=True)
class LogColumns:
    """How to read records: key, version (null: no information), arrival, id."""

    key: Column
    version: Column
    arrived: str = "arrived_at"
    record_id: str = "entry_id"


@dataclass(frozen=True)
class Batch:
    """A planned batch: for each partition the offsets [from, until)."""

    batch_id: int
    run_id: int
    #: Whether the run is to commit; the batch of one that failed goes to the next.
    counts: bool
    from_seq: list[int]
    until_seq: list[int]


class ChangeCapture:
    """Captures the changed keys of a log into a sink below ``root``.

    Records without key, version or arrival time give no information and are
    not taken in. A key's state is its record with the latest arrival; equal
    arrivals are ordered by record id, equal ids too by the greater version. A
    record delivered again, in the same segment or later, changes nothing.
    ``partitions``, of the log and of the states, is fixed by the first
    segment; without it, it is the session's number of shuffle partitions.
    """

    def __init__(self, spark: SparkSession, root: str, partitions: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.control = Control(spark, self.root)
        segments = self.control.numbers("ends")
        self.partitions = len(self.control.get("ends", segments[0])["until"]) if segments else partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _read(self, name: str, folders: Sequence[str], schema: str) -> DataFrame:
        """Folders of a table, without looking at any other."""
        found = self.spark.createDataFrame([], schema)
        if not folders:
            return found
        paths = [f"{self.root}/{name}/{f}" for f in folders]
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths).select(found.columns)

    # -- control

    def ends(self) -> list[int]:
        """The offset that each partition of the log has reached."""
        segments = self.control.numbers("ends")
        return self.control.get("ends", segments[-1])["until"] if segments else [0] * self.partitions

    def committed(self) -> int:
        """The last batch committed, 0 before the first."""
        return max(self.control.numbers("commits"), default=0)

    def plans(self) -> list[Batch]:
        """The batches of the last plan and those that may not be committed yet."""
        last, numbers = self.committed(), self.control.numbers("plans")
        kept = [n for i, n in enumerate(numbers) if n > last or i + 1 == len(numbers) or numbers[i + 1] > last]
        return [Batch(**b) for n in kept for b in self.control.get("plans", n)]

    def pending(self) -> list[Batch]:
        """Batches planned but not committed, oldest first."""
        done = self.committed()
        return [b for b in self.plans() if b.batch_id > done]

    # -- taking in

    def ingest(self, records: DataFrame, columns: LogColumns) -> int:
        """Append records to the log and give the segment's number.

        An attempt that broke off is replaced by the next one.
        """
        base = self.ends()
        segment = max(self.control.numbers("ends"), default=0) + 1
        rows = records.select(
            columns.key.alias("key"),
            columns.version.alias("version"),
            F.unix_micros(F.col(columns.arrived).cast("timestamp")).alias("arrived_us"),
            F.col(columns.record_id).cast("bigint").alias("record_id"),
        ).where(F.col("key").isNotNull() & F.col("version").isNotNull() & F.col("arrived_us").isNotNull())
        hashed = rows.withColumn("part", F.pmod(F.xxhash64("record_id", "arrived_us", "key"), F.lit(self.partitions)).cast("int"))
        in_order = Window.partitionBy("part").orderBy("arrived_us", "record_id", "version")
        numbered = hashed.withColumn("n", F.row_number().over(in_order).cast("bigint")).withColumn("base", F.get(F.lit(base).cast("array<bigint>"), F.col("part")))
        placed = numbered.select("part", (F.col("base") + F.col("n") - 1).alias("seq"), "key", "version", "arrived_us", "record_id", F.pmod(F.xxhash64("key"), F.lit(self.partitions)).cast("int").alias("bucket"))
        path = f"{self.root}/log/segment={segment}"
        placed.write.mode("overwrite").parquet(path)
        reached = {r[0]: r[1] for r in self.spark.read.schema(LOG).parquet(path).groupBy("part").agg(F.max("seq") + 1).collect()}
        self.control.put("ends", segment, {"from": base, "until": [max(b, reached.get(p, 0)) for p, b in enumerate(base)]})
        return segment

    def _log(self, low: list[int], high: list[int]) -> DataFrame:
        """Log records of which some partition may have offsets [low, high); other segments and row groups are not read."""
        wanted = []
        for n in reversed(self.control.numbers("ends")):
            span = self.control.get("ends", n)
            if any(f < h and u > lo and f < u and lo < h for f, u, lo, h in zip(span["from"], span["until"], low, high)):
                wanted.append(n)
            if all(f <= lo for f, lo in zip(span["from"], low)):
                break
        open_ = [(lo, h) for lo, h in zip(low, high) if lo < h] or [(0, 0)]
        rows = self._read("log", [f"segment={n}" for n in sorted(wanted)], LOG)
        return rows.where((F.col("seq") >= F.lit(min(x[0] for x in open_))) & (F.col("seq") < F.lit(max(x[1] for x in open_))))

    # -- planning

    def plan(self, run_id: int, until_us: int) -> int:
        """Write ahead the batch of a run that starts at ``until_us``; returns its number."""
        return self._plan([(run_id, until_us, True)])

    def plan_runs(self, runs: DataFrame, run: str = "run_id", started: str = "started_at", ok: Column | None = None) -> None:
        """Write ahead one batch for each run, in order of start, then id.

        A run that is not ``ok`` (without the argument all are) plans its batch
        too but never commits it; the next run that is takes it over. Runs
        without id or start are none. The runs are control rows, PLANNED of which
        are planned at a time.
        """
        known = runs.where(F.col(started).isNotNull() & F.col(run).isNotNull()).select(F.col(run).cast("int").alias("run_id"), F.unix_micros(F.col(started).cast("timestamp")).alias("at"), (F.lit(True) if ok is None else F.coalesce(ok, F.lit(False))).alias("counts"))
        starts = [tuple(r) for r in known.groupBy("run_id").agg(F.min("at").alias("at"), F.max("counts").alias("counts")).orderBy("at", "run_id").collect()]
        for i in range(0, len(starts), PLANNED):
            self._plan(starts[i : i + PLANNED])

    def _plan(self, starts: list[tuple[int, int, bool]]) -> int:
        before, end = self.plans(), self.ends()
        last, low = (before[-1].batch_id, before[-1].until_seq) if before else (0, [0] * len(end))
        i = F.when(F.col("arrived_us") >= starts[-1][1], len(starts)).otherwise(interval_of(F.col("arrived_us"), [F.lit(s[1]) for s in starts]))
        # For each partition the first record yet to be planned that arrives between two starts: a few rows a partition.
        ahead = self._log(low, end).where(F.col("seq") >= F.get(F.lit(low).cast("array<bigint>"), F.col("part")))
        first = {(r[0], r[1]): r[2] for r in ahead.groupBy("part", i.alias("i")).agg(F.min("seq")).collect()}
        batches = []
        for k, (run_id, _, counts) in enumerate(starts):
            until = [min((first[p, j] for j in range(k + 1, len(starts) + 1) if (p, j) in first), default=e) for p, e in enumerate(end)]
            batches.append(Batch(last + 1 + k, run_id, counts, low, until))
            low = until
        self.control.put("plans", last + 1, [asdict(b) for b in batches])
        return batches[-1].batch_id

    # -- executing

    def execute(self, fail: bool = False) -> int:
        """Capture pending batches of up to RUNS successful runs in one pass, then commit them.

        The offsets come from the written plans alone, and what an earlier
        attempt wrote is replaced. ``fail`` stops between the write and the
        commit, for tests. Returns the number of batches committed, 0 if
        there is nothing to do; batches of failed runs that no successful one
        follows stay pending.
        """
        groups, open_ = [], []
        for batch in self.pending():
            open_.append(batch)
            if batch.counts:
                groups.append(open_)
                open_ = []
        groups = groups[:RUNS]
        if not groups:
            return 0
        first, last = groups[0][0].batch_id, groups[-1][-1].batch_id
        self._capture(groups, first)
        if fail:
            raise RuntimeError("stopped before the commit")
        touched = {b[5:]: first for b in self.control.names(f"passes/pass={first}/kind=state")}
        self.control.put("commits", last, self._manifest() | touched)
        return sum(map(len, groups))

    def _capture(self, groups: list[list[Batch]], first: int) -> None:
        """Write the sink rows and states of a pass."""
        low, high = groups[0][0].from_seq, groups[-1][-1].until_seq
        # For each partition its own bounds: where it starts, and the offset at which each run's batches end.
        at = [f"_u{i}" for i in range(len(groups))]
        bounds = self.spark.createDataFrame([(p, low[p], *(g[-1].until_seq[p] for g in groups)) for p in range(len(low))], "part int, _lo bigint, " + ", ".join(f"{c} bigint" for c in at))
        rows = self._log(low, high).join(bounds, "part").where((F.col("seq") >= F.col("_lo")) & (F.col("seq") < F.col(at[-1])))
        placed = rows.withColumn("_g", interval_of(F.col("seq"), [F.col(c) for c in at]))
        # The newest record of each key in each group, combined on the map
        # side: a key with a third of all rows leaves a task once per group.
        newest = placed.groupBy("bucket", "key", "_g").agg(F.max(F.struct("arrived_us", "record_id", "version", "part", "seq")).alias("s"))
        if manifest := self._manifest():
            touched = {str(r[0]) for r in rows.select("bucket").distinct().collect()}
            known = self._states({b: p for b, p in manifest.items() if b in touched})
            newest = newest.unionByName(known.select("bucket", "key", F.lit(-1).alias("_g"), F.struct("arrived_us", "record_id", "version", "part", "seq").alias("s")))
        in_order = Window.partitionBy("bucket", "key").orderBy("_g")
        seen = (
            newest.repartition("bucket")
            .withColumn("now", F.max("s").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("before", F.max("s").over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn("is_last", F.lead("_g").over(in_order).isNull())
        )
        moved = (F.col("_g") >= 0) & ~F.col("now.version").eqNullSafe(F.col("before.version"))
        kinds = F.filter(F.array(F.when(moved, F.struct(F.lit("sink").alias("kind"), F.lit(0).alias("slot"))), F.when(F.col("is_last"), F.struct(F.lit("state").alias("kind"), F.col("bucket").alias("slot")))), lambda x: x.isNotNull())
        named = self.spark.createDataFrame([(i, g[-1].batch_id, g[-1].run_id) for i, g in enumerate(groups)], "_g int, batch_id bigint, run_id int")
        out = seen.select("_g", "bucket", "key", "now.*", F.inline(kinds)).join(named, "_g", "left")
        out.select("batch_id", "run_id", "bucket", "key", "version", "arrived_us", "record_id", "part", "seq", "kind", "slot").write.mode("overwrite").partitionBy("kind", "slot").parquet(f"{self.root}/passes/pass={first}")

    def _manifest(self) -> dict[str, int]:
        """Bucket to the pass that holds its states; as many as buckets."""
        last = self.committed()
        return self.control.get("commits", last) if last else {}

    def _states(self, buckets: dict[str, int]) -> DataFrame:
        return self._read("passes", [f"pass={p}/kind=state/slot={b}" for b, p in sorted(buckets.items())], STATE)

    def state(self) -> DataFrame:
        """Newest committed record of each key (columns of STATE)."""
        return self._states(self._manifest())

    def sink(self) -> DataFrame:
        """Committed changes (columns of CHANGE); a (key, offset) once."""
        last = self.committed()
        passes = [n for n in self.control.names("passes") if int(n[5:]) <= last]
        return self._read("passes", [f"{n}/kind=sink" for n in passes if self.control.exists(f"passes/{n}/kind=sink")], CHANGE).dropDuplicates(["key", "part", "seq"])

    def drop(self) -> None:
        delete(self.spark, self.root)


def interval_of(value: Column, bounds: list[Column]) -> Column:
    """Index of the first bound greater than ``value``; equal bounds share the first.

    A balanced tree of comparisons inside generated code: log2 of the number
    of bounds for a row, with no join and no array to scan.
    """

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value < bounds[mid], tree(low, mid)).otherwise(tree(mid + 1, high))

    return tree(0, len(bounds) - 1).cast(T.IntegerType())
