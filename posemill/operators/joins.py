"""Joins on declared or shared columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beside(df: DataFrame, one: DataFrame) -> DataFrame:
    """The columns of a one-row table beside every row, as a scalar subquery instead of a join; nulls where it has no row."""
    name = "_beside"
    while name in df.columns:
        name += "_"
    value = one.select(F.struct("*").alias("one")).scalar()
    return df.select("*", value.alias(name)).select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"{name}.`{c}`").alias(c) for c in one.columns])


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in set(right.columns)]


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null matches null (NaN matches NaN in any Spark join).

    Keys appear once, from whichever side has them; clashing other columns are refused. No keys is refused too: that would
    be a cross join. An empty side behaves as in SQL.
    """
    if not on:
        raise ValueError("the tables share no column")
    clash = (set(left.columns) & set(right.columns)) - set(on)
    if clash:
        raise ValueError(f"columns on both sides that are no keys: {sorted(clash)}")
    mark = "_right_"
    while any(c.startswith(mark) for c in left.columns + right.columns):
        mark += "_"
    renamed = right.withColumnsRenamed({c: f"{mark}{c}" for c in on})
    both = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{mark}{c}")) for c in on])
    joined = left.join(renamed, both, how)
    if how in ("left_semi", "left_anti"):
        return joined
    keys = [F.coalesce(c, f"{mark}{c}").alias(c) if how in ("full", "outer", "right") else F.col(c) for c in on]
    return joined.select(*keys, *[c for c in left.columns if c not in on], *[c for c in right.columns if c not in on])


def natural_join(*frames: DataFrame, how: str = "inner") -> DataFrame:
    """Null-safe join of two or more tables on all columns neighbours share; ``how`` inner or full."""
    return reduce(lambda a, b: null_safe_join(a, b, shared_columns(a, b), how), frames)


def join_all(on: list[str], *frames: DataFrame, how: str = "inner") -> DataFrame:
    """n-ary SQL join on declared keys: null keys match nothing."""
    def two(a: DataFrame, b: DataFrame) -> DataFrame:
        clash = (set(a.columns) & set(b.columns)) - set(on)
        if clash:
            raise ValueError(f"columns on both sides that are no keys: {sorted(clash)}")
        return a.join(b, on, how)

    return reduce(two, frames)


def members(df: DataFrame, keys: DataFrame, on: list[str], keep: bool = True) -> DataFrame:
    """Rows whose key occurs in ``keys`` (or, with keep=False, does not); null keys never occur."""
    return df.join(keys.select(*on).distinct(), on, "left_semi" if keep else "left_anti")
