"""Ranks. Ties are settled as stated; nulls and NaN take no part unless stated."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posemill.operators.joins import null_safe_join
from posemill.runtime import Scratch

HOT_ROWS = 200_000


def _present(column: str) -> Column:
    return F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))


def running_totals(
    df: DataFrame, by: list[str], value: str, sums: dict[str, tuple[str, str]], descending: bool = False, hot_rows: int = HOT_ROWS, parts: int | None = None,
) -> DataFrame:
    """df with running sums and group totals (column -> their names) in the order of a number, one row per group and value given.

    Where no group has more than ``hot_rows`` rows, plain windows over the groups do. Else the values are cut into ranges of
    about ``hot_rows`` rows (at most 10 000 of them, or ``parts``) at approximate percentiles; totals of whole ranges are added
    up per group first, and only the rows of one range of one group are ever ordered together. So neither a group with most of the rows
    nor a table without groups is sorted in one task. The table is written once, being read again.
    """
    df = Scratch(df.sparkSession, "totals").cut(df)
    total, most = df.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.sum("_n"), F.max("_n")).first()
    order = F.col(value).desc() if descending else F.col(value).asc()
    group = Window.partitionBy(*by)
    if (most or 0) <= hot_rows:
        upto = group.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[x for c, (n, t) in sums.items() for x in (F.sum(c).over(upto).alias(n), F.sum(c).over(group).alias(t))])
    number = F.col(value).cast("double")
    parts = parts or min(10_000, 1 + total // hot_rows * 4)
    bounds = df.agg(F.percentile_approx(number, [i / parts for i in range(1, parts)], max(1000, 2 * parts))).first()[0] if parts > 1 else []
    edges = [-float("inf"), *sorted({float(x) for x in bounds if abs(x) < float("inf")}), float("inf")]
    cut = Bucketizer(splits=edges, inputCol="_number", outputCol="_bucket")
    part = F.col("_bucket").cast("int")
    ranged = cut.transform(df.withColumn("_number", number)).withColumn("_part", -part if descending else part).drop("_number", "_bucket")
    upto = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = ranged.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums)])
    known = [x for i in range(len(sums)) for x in (F.coalesce(F.sum(f"_t{i}").over(upto), F.lit(0)).alias(f"_b{i}"), F.sum(f"_t{i}").over(group).alias(f"_a{i}"))]
    inside = Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = null_safe_join(ranged, whole.select(*by, "_part", *known), [*by, "_part"])
    added = [x for i, (c, (n, t)) in enumerate(sums.items()) for x in ((F.col(f"_b{i}") + F.sum(c).over(inside)).alias(n), F.col(f"_a{i}").alias(t))]
    return joined.select(*df.columns, *added)


def distinct_ranks(df: DataFrame, column: str, by: list[str] | None = None, descending: bool = False) -> DataFrame:
    """One row per group and value: by..., value, _ties, _before (rows that sort earlier), _total, _dense.

    Rows are counted per value before anything is ordered, so the windows see each distinct value once, in ranges.
    """
    by = by or []
    counts = df.where(_present(column)).groupBy(*by, column).agg(F.count("*").alias("_ties")).withColumn("_each", F.lit(1).cast("long"))
    ranked = running_totals(counts, by, column, {"_ties": ("_upto", "_total"), "_each": ("_dense", "_values")}, descending)
    return ranked.withColumn("_before", F.col("_upto") - F.col("_ties")).drop("_upto", "_each", "_values")


def add_ranks(df: DataFrame, column: str, method: str, into: str, by: list[str] | None = None, descending: bool = False) -> DataFrame:
    """Rank of every row in its group: method min, dense, average or share (average rank / n). Null for missing values."""
    ranks = distinct_ranks(df, column, by, descending)
    average = F.col("_before") + (F.col("_ties") + 1) / 2
    value = {
        "min": F.col("_before") + 1, "dense": F.col("_dense"), "average": average, "share": average / F.col("_total"),
    }[method]
    return null_safe_join(df, ranks.select(*(by or []), column, value.alias(into)), [*(by or []), column], "left")


def first_in_group(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row per group, the first in a total order; reduced map-side before the shuffle."""
    return df.withColumn("_row", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_row = 1").drop("_row")


def negative_zscore(df: DataFrame, column: str, into: str, by: list[str]) -> DataFrame:
    """-(x - mean)/population deviation of the group; 0 for a constant group, null for missing values."""
    clean = F.when(_present(column), F.col(column))
    stats = df.groupBy(*by).agg(F.avg(clean).alias("_a"), F.stddev_pop(clean).alias("_s"))
    z = F.coalesce(F.try_divide(F.col("_a") - clean, F.col("_s")), clean * 0)
    return null_safe_join(df, stats, by, "left").withColumn(into, z).drop("_a", "_s")
