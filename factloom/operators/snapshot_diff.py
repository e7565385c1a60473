"""Problem 4: what changed between consecutive full snapshots.

Full outer join on the primary key of each snapshot with the next one,
comparing hashes of the canonical rows. Both sides come from one shuffled and
de-duplicated table, in which the later snapshot's rows stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def snapshot_order(snapshots: DataFrame, snapshot: str, captured: str) -> DataFrame:
    """(snapshot, seq) by time of capture, ties by id; one row per snapshot.

    The number of snapshots is small against their rows; the numbering runs
    over the distinct ids only.
    """
    ids = snapshots.where(F.col(snapshot).isNotNull()).groupBy(snapshot).agg(F.min(captured).alias("_at"))
    return ids.select(snapshot, F.row_number().over(Window.orderBy(F.col("_at").asc_nulls_first(), snapshot)).alias("_seq"))


def diff_snapshots(
    snapshots: DataFrame,
    key: dict[str, Column],
    compared: list[Column],
    snapshot: str = "snapshot_id",
    captured: str = "captured_at",
    delivered: str = "delivered_at",
) -> DataFrame:
    """Rows (snapshot, change, *key): ``added``, ``removed`` or ``changed``.

    ``key`` names the columns of the primary key; a row with a null in it is
    ignored. ``compared`` are the canonical values whose hash tells whether a
    row changed. A key delivered several times in a snapshot counts once, with
    its last delivery (ties: the greater hash). The first snapshot has no
    cases, and an empty or single snapshot gives no rows.
    """
    names = list(key)
    order = snapshot_order(snapshots, snapshot, captured)
    rows = snapshots.select(F.col(snapshot).alias("_snap"), *[c.alias(k) for k, c in key.items()], F.col(delivered).alias("_delivered"), F.xxhash64(*compared).alias("_hash"))
    rows = rows.where(F.col("_snap").isNotNull())
    for k in names:
        rows = rows.where(F.col(k).isNotNull())
    # Combined by key and snapshot before the shuffle: repeated deliveries meet
    # here. The join is on the same columns in the same order, so the later
    # side lies where it is and only the earlier one moves again.
    rows = rows.groupBy(*names, "_snap").agg(F.max(F.struct("_delivered", "_hash"))["_hash"].alias("_hash"))
    steps = order.select(F.col(snapshot).alias("_snap"), F.lead(snapshot).over(Window.orderBy("_seq")).alias("_next"), (F.col("_seq") == 1).alias("_first"))
    # One row per snapshot, so the broadcasts are as small as their number.
    before = rows.join(F.broadcast(steps.where(F.col("_next").isNotNull()).select("_snap", "_next")), "_snap").select(*names, F.col("_next").alias("_to"), F.col("_hash").alias("_old"))
    after = rows.join(F.broadcast(steps.where(~F.col("_first")).select("_snap")), "_snap").select(*names, F.col("_snap").alias("_to"), F.col("_hash").alias("_new"))
    joined = before.alias("b").join(after.alias("a"), [*names, "_to"], "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return joined.withColumn("change", change).where(F.col("change").isNotNull()).select(F.col("_to").alias(snapshot), "change", *names)
