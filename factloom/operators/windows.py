"""Window functions for keys that may hold a great part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Positions in one block of a key.
WIDTH = 1_000_000


def blocked_lag(df: DataFrame, key: list[str], order: str, value: str, name: str, width: int = WIDTH) -> DataFrame:
    """``df`` with ``name``: the value of the row before, by the number ``order``, within a key.

    A key's rows are sorted in blocks of ``width`` positions, each its own
    group; only the last value of each block is passed on to the next one, so
    no task sorts all rows of a large key. ``order`` must tell a key's rows
    apart; rows without it, or with a null in the key, get null.
    """
    placed = df.withColumn("_blk", F.floor(F.col(order) / F.lit(width)))
    w = Window.partitionBy(*key, "_blk").orderBy(order)
    inside = placed.withColumns({"_in": F.lag(value).over(w), "_nth": F.row_number().over(w)})
    ends = placed.where(F.col(order).isNotNull()).groupBy(*key, "_blk").agg(F.max_by(value, order).alias("_last"))
    before = ends.withColumn("_before", F.lag("_last").over(Window.partitionBy(*key).orderBy("_blk"))).drop("_last")
    out = inside.join(before, [*key, "_blk"], "left")
    return out.withColumn(name, F.when(F.col("_nth") == 1, F.col("_before")).otherwise(F.col("_in"))).drop("_blk", "_in", "_nth", "_before")
