"""Problem 2: frequency of every distinct term.

Recursive radix spilling. Occurrences, first combined by term and record, are
written to the shared folder in partitions by hash bits of the term. Partitions
with more rows or bytes than fit are read again and written by the next bits,
as many as the largest of them needs. What is too large even then holds a term
that fills it alone, so later levels take their bits from the record: records
are disjoint then, and the partial counts of a term just add up. Every
partition that fits is aggregated by DuckDB from its files, several tasks side
by side; the partial counts are summed at the end.

A level is rebalanced by partition before it is written, so a partition lies
in few files, and one that is large is written by several tasks.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from math import ceil, log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.scratch import Scratch

#: Hash bits of the first level, and the most that a later one uses.
FIRST, MOST = 6, 10
#: Rows and bytes that one partition may hold before it is split further.
ROWS, BYTES = 1_000_000, 64_000_000
#: What DuckDB may use in a task before it goes to disk; a partition that fits needs less.
MEMORY = "400MB"

_COUNTS = pa.schema([("field", pa.string()), ("term", pa.string()), ("total", pa.int64()), ("records", pa.int64())])
_SPILLED = "field string, term string, record string, n bigint, path string"


def _bits(of: Column, start: int, width: int) -> Column:
    """The partition's name at a level: ``width`` bits of a hash, from ``start`` on."""
    return F.concat(F.lit("p"), F.lpad(F.hex(F.shiftrightunsigned(of, start).bitwiseAND(F.lit((1 << width) - 1))), 3, "0"))


def _spill(pairs: DataFrame, scratch: Scratch, rows: int, size: int) -> tuple[DataFrame, list[tuple[str, DataFrame]]]:
    """The table of the first level, and the partitions that fit: (folder of a level, its (path, rows) table).

    ``path`` is the chain of partitions from the top, such as ``p007-p0f5``.
    """
    term, record = F.xxhash64("field", "term"), F.xxhash64("record", F.lit(1))
    level, width, used, leaves = 0, FIRST, 0, []
    left, first = pairs.withColumn("path", F.lit(None).cast("string")), None
    while True:
        # The first two levels split by the term, later ones by the record.
        step = _bits(term, FIRST * level, width) if level < 2 else _bits(record, used, width)
        spread = left.select("field", "term", "record", "n", F.concat_ws("-", "path", step).alias("path"))
        folder = scratch.path(f"level-{level}")
        spread.hint("rebalance", "path").write.mode("overwrite").option("compression", "snappy").partitionBy("path").parquet(folder)
        done = scratch.spark.read.schema(_SPILLED).parquet(folder)
        first = done if level == 0 else first
        weight = F.sum(F.octet_length("term") + F.coalesce(F.octet_length("record"), F.lit(0)) + 32)
        # Saved: a row for each partition, whose size the planner then sees.
        sizes = scratch.save(done.groupBy("path").agg(F.count("*").alias("rows"), weight.alias("bytes")), f"sizes-{level}")
        used += width if level >= 2 else 0
        over = F.greatest(F.col("rows") / rows, F.when(F.col("rows") > 1, F.col("bytes") / size).otherwise(0.0))
        most = sizes.agg(F.max(over)).first()[0]
        if most is None or most <= 1 or used >= 64:
            leaves.append((folder, sizes.select("path", "rows")))
            return first, leaves
        leaves.append((folder, sizes.where(over <= 1).select("path", "rows")))
        left = done.join(sizes.where(over > 1).select("path"), "path", "left_semi")
        width = min(MOST, ceil(log2(most)) + 1, 64 - used)
        level += 1


def _aggregate(leaves: DataFrame, rows: int) -> DataFrame:
    """Partial counts of each leaf (folder, path, rows) by DuckDB over its files.

    The number of tasks is given, so that adaptive execution doesn't put the
    short list of leaves into one: a task for each ``rows`` rows, no fewer
    than the cluster can run at once and no more than there are leaves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        import pyarrow.dataset as ds
        from pyarrow import fs

        for batch in batches:
            for folder, path in zip(*(c.to_pylist() for c in batch.columns[:2])):
                system, where = fs.FileSystem.from_uri(f"{folder}/path={path}")
                spilled = ds.dataset(where, filesystem=system, format="parquet")
                # DuckDB spills to the shared folder where that is a path it can open. Elsewhere
                # it has none: a leaf is bounded in rows and bytes so that its counts fit.
                own = f"{os.path.dirname(os.path.dirname(where))}/duckdb-{uuid.uuid4().hex}" if system.type_name == "local" else ""
                try:
                    with duckdb.connect(config={"memory_limit": MEMORY, "threads": 1, "temp_directory": own, "preserve_insertion_order": False}) as db:
                        db.register("spilled", spilled.scanner(columns=["field", "term", "record", "n"], batch_size=65536).to_reader())
                        for out in db.sql("SELECT field, term, sum(n)::BIGINT AS total, count(record) AS records FROM spilled GROUP BY field, term").to_arrow_reader(65536):
                            yield out.cast(_COUNTS)
                finally:
                    if own:
                        shutil.rmtree(own, ignore_errors=True)

    n, total = leaves.agg(F.count("*"), F.sum("rows")).first()
    tasks = max(1, min(n, max(leaves.sparkSession.sparkContext.defaultParallelism, ceil((total or 0) / rows))))
    return leaves.repartition(tasks).mapInArrow(run, "field string, term string, total bigint, records bigint")


def term_frequencies(occurrences: DataFrame, rare_below: int = 5, common_above: float = 0.30, rows: int = ROWS, size: int = BYTES, label: str = "terms") -> DataFrame:
    """(field, term, total, records, mark) of each distinct term of each field.

    ``occurrences`` has (field, term, record). Terms lose surrounding spaces,
    tabs and line breaks and become lower case; null or empty ones are none.
    A null record counts towards ``total`` only. ``records`` is the number of
    distinct records with the term; ``mark`` is ``rare`` below ``rare_below``
    records, else ``common`` above the share ``common_above`` of the field's
    records that hold any term, else null. Partitions of more than ``rows``
    rows or ``size`` bytes are split further. Nothing is sampled or capped; an
    empty input gives no rows.
    """
    spark = occurrences.sparkSession
    scratch = Scratch(spark, label)
    term = F.lower(F.regexp_replace(F.col("term"), r"^[ \t\r\n]+|[ \t\r\n]+$", ""))
    clean = occurrences.select("field", term.alias("term"), "record").where((F.col("term") != "") & F.col("field").isNotNull())
    # Combined by term and record on the map side; a hot term is spread by its records.
    pairs = clean.groupBy("field", "term", "record").agg(F.count("*").alias("n"))
    leaves = None
    first, spilled = _spill(pairs, scratch, rows, size)
    for folder, paths in spilled:
        named = paths.select(F.lit(folder).alias("folder"), "path", "rows")
        leaves = named if leaves is None else leaves.unionByName(named)
    partial = _aggregate(leaves, rows)
    counts = partial.groupBy("field", "term").agg(F.sum("total").alias("total"), F.sum("records").alias("records"))
    # A record holds one term of a field or several, so the base is counted over records. Saved: a row for each field.
    base = scratch.save(_records_by_field(first.where(F.col("record").isNotNull())), "base")
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(common_above) * F.col("base"), "common")
    return counts.join(base, "field", "left").select("field", "term", "total", "records", mark.alias("mark"))


def _records_by_field(pairs: DataFrame) -> DataFrame:
    """(field, base): distinct records with any term."""
    return pairs.select("field", "record").distinct().groupBy("field").agg(F.count("*").alias("base"))
