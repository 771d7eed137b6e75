"""Joins of rows with a table of their groups when a few groups hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 200_000


def hot_limit(total: int, hot_rows: int = HOT_ROWS) -> int:
    """Groups of more rows are hot; there are at most 1000 of them."""
    return max(hot_rows, total // 1000)


def join_groups(rows: DataFrame, groups: DataFrame, by: list[str], size: str, limit: int | None) -> DataFrame:
    """Inner join on the group keys, ``groups`` having one row per group and its number of rows in ``size``.

    Rows of hot groups meet a broadcast of the hot groups alone (at most 1000 rows) where they are, so that counting them
    aggregates map-side; the others are joined by Spark's choice. limit None: no group is hot.
    """
    if limit is None:
        return rows.join(groups, by)
    hot = F.broadcast(groups.where(F.col(size) > limit))
    cold = rows.join(F.broadcast(groups.where(F.col(size) > limit).select(*by)), by, "left_anti")
    return rows.join(hot, by).unionByName(cold.join(groups.where(F.col(size) <= limit), by))
