"""Interval joins by bins.

An interval [start, stop) is spread over the bins it touches and a point lies
in one bin, so the join is an equi-join on (key, bin) with the bounds as its
residue: no cross join, and a key with very many rows is spread over its bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin(value: Column, width: int) -> Column:
    return F.floor(value / F.lit(width)).cast("bigint")


def binned_intervals(intervals: DataFrame, start: str, stop: str, width: int) -> DataFrame:
    """One row per interval and bin (column ``_bin``); empty and null intervals give none."""
    return intervals.where(F.col(start) < F.col(stop)).withColumn("_bin", F.explode(F.sequence(_bin(F.col(start), width), _bin(F.col(stop) - 1, width))))


def points_in_intervals(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, stop: str, how: str = "inner", width: int = 4096, also: Column | None = None) -> DataFrame:
    """Points joined with the intervals of the same key that hold them, ``start <= at < stop``.

    ``how`` may be inner, left_semi or left_anti. With inner, a point in
    several (also nested) intervals comes out once for each. ``also`` is a
    further condition over both sides' columns; interval columns other than
    the key must differ in name from the points'. Points without key or
    position lie in no interval.
    """
    p = points.withColumn("_bin", _bin(F.col(at), width))
    i = binned_intervals(intervals, start, stop, width).withColumnRenamed(key, "_key").withColumnRenamed("_bin", "_ibin")
    on = (F.col(key) == F.col("_key")) & (F.col("_bin") == F.col("_ibin")) & (F.col(at) >= F.col(start)) & (F.col(at) < F.col(stop))
    return p.join(i, on if also is None else on & also, how).drop("_bin", "_ibin", "_key")


def innermost(points: DataFrame, scopes: DataFrame, key: str, at: str, start: str, stop: str, label: str, point_id: list[str], width: int = 4096) -> DataFrame:
    """(point_id, label) of the smallest interval around each point; ties by the later start, then the label."""
    hits = points_in_intervals(points, scopes, key, at, start, stop, "inner", width)
    best = F.min(F.struct(F.col(stop) - F.col(start), -F.col(start), F.col(label)))
    return hits.groupBy(*point_id).agg(best[label].alias(label))
