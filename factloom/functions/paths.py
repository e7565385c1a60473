"""Path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_path(path: Column) -> Column:
    """A path with slashes only and without one leading ``./``; null stays null."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")
