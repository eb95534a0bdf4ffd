"""Arrays to rows without computing the array twice.

For a plain ``explode`` Spark adds a filter on the size of the array below it, and
pushes filters on computed columns the same way; both repeat the expression. The
outer forms with a filter on their output compute an array once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keep = Sequence[str | Column]


def positions(df: DataFrame, keep: Keep, array: Column, position: str, item: str) -> DataFrame:
    """One row per item with its position; none for an empty or missing array."""
    rows = df.select(*keep, F.posexplode_outer(array).alias(position, item))
    return rows.filter(F.col(position).isNotNull())


def structs(df: DataFrame, keep: Keep, array: Column, always: str) -> DataFrame:
    """One row per struct with its fields; ``always`` names one that is never null."""
    rows = df.select(*keep, F.inline_outer(array))
    return rows.filter(F.col(always).isNotNull())
