"""Exact positions in a total order, without a window over all rows.

A global sort deals rows to contiguous ranges; a row's place within its range comes with the sort, and the sizes of the ranges
before it are added once all are known. One range shuffle, one written table, no task that holds more than its range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import storage

_PLACE_BITS = 33  # monotonically_increasing_id: the partition above, the place within it below


def _written(df: DataFrame) -> DataFrame:
    return storage.written(df, "ranked")


def numbered(df: DataFrame, order: list[Column | str], name: str = "place", write: Callable[[DataFrame], DataFrame] = _written) -> DataFrame:
    """Adds ``name`` (long, from 1): each row's place in an order.

    Rows that are equal in the order are numbered one after another in the order in which they are read, and they are dealt
    to several ranges where they are many. ``df`` is read twice (for the bounds of the ranges, then to sort), so it should be
    a table, or cheap. An empty table stays empty. ``write`` writes a frame to a shared place and gives it back as read.
    """
    clash = {name, "_tie", "_at", "_range"} & set(df.columns)
    if clash:
        raise ValueError(f"columns with clashing names: {sorted(clash)}")
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = df.withColumn("_tie", F.monotonically_increasing_id()).orderBy(*keys, "_tie").drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    placed = write(placed)
    in_range = F.shiftright("_at", _PLACE_BITS).cast("int")
    sizes = sorted((r["_range"], r["count"]) for r in placed.groupBy(in_range.alias("_range")).count().collect())  # a row a range, not a row a row
    before, offsets = 0, []
    for k, n in sizes:
        offsets.append((k, before))
        before += n
    first = df.sparkSession.createDataFrame(offsets, "_range int, _before long")
    joined = placed.withColumn("_range", in_range).join(F.broadcast(first), "_range")
    return joined.select(*df.columns, (F.col("_before") + F.col("_at").bitwiseAND((1 << _PLACE_BITS) - 1) + 1).alias(name))
