"""Intermediate tables in the folder all executors share.

Iterative operators cut lineage by writing a table here and reading it back:
a lost executor then costs only the running stage. The folder comes from
``spark.checkpoint.dir``; only where that is unset (tests, one machine) one is
made under the temporary directory.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI without a trailing slash."""
    found = spark.sparkContext.getConf().get(KEY) or spark.conf.get(KEY, None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"{KEY} must name a shared folder on a cluster")
        found = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def exists(spark: SparkSession, uri: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def delete(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """A run's own folder below the shared one.

    ``save`` writes a DataFrame as parquet and gives it back as a scan;
    ``drop`` removes a table that nothing will read again. What is left goes
    when the application ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/factloom/{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.clear)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        writer = df.write.mode("overwrite").option("compression", "snappy")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        delete(self.spark, self.path(name))

    def clear(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:
            pass
