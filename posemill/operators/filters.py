"""Filters relative to a group."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posemill.operators.joins import beside, null_safe_join
from posemill.operators.quantiles import group_quantiles
from posemill.runtime import Scratch


def top_window(df: DataFrame, by: list[str], score: str, window: float, most: int | None) -> DataFrame:
    """Rows within ``window`` of their group's lowest score and, unless ``most`` is None, of minimum rank <= most.

    Without ``by`` the lowest score of the table counts. Group minima are aggregated first and joined back; only rows inside
    the window are then ranked. Null and NaN scores are left out; tied rows share a rank, so ties stay or go together; null
    keys are a group.
    """
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    low = F.min(score).alias("_low")
    near = null_safe_join(rows, rows.groupBy(*by).agg(low), by) if by else beside(rows, rows.agg(low))
    near = near.where(F.col(score) - F.col("_low") <= window).drop("_low")
    if most is None:
        return near
    return near.withColumn("_rank", F.rank().over(Window.partitionBy(*by).orderBy(score))).where(F.col("_rank") <= most).drop("_rank")


def group_size(df: DataFrame, by: list[str], into: str) -> DataFrame:
    """Number of rows of every row's group, as a column."""
    return null_safe_join(df, df.groupBy(*by).agg(F.count("*").alias(into)), by)


def mad_mask(df: DataFrame, by: list[str], value: str, threshold: float, into: str = "is_outlier", logarithm: bool = False) -> DataFrame:
    """Whether 0.6745*|x - median| exceeds threshold * median(|x - median|) of the group; exact medians.

    Written without division, so with a MAD of 0 whatever deviates is an outlier and the rest is kept. A group of one
    row, and null or NaN values, are no outliers. Without ``by`` the whole table is the group. With ``logarithm`` log10 of
    the value is judged (null for values <= 0). Medians of large groups are found by rank, see quantiles.group_quantiles.
    """
    c = F.col(value).cast("double")
    x = F.when(~F.isnan(c), F.when(c > 0, F.log10(c)) if logarithm else c)

    def back(rows: DataFrame, of: str, into: str) -> DataFrame:
        middle = group_quantiles(rows, by, of, {into: 0.5})
        return null_safe_join(rows, middle, by) if by else beside(rows, middle)

    rows = back(df.withColumn("_x", x), "_x", "_m").withColumn("_d", F.abs(F.col("_x") - F.col("_m")))
    rows = back(rows, "_d", "_mad")
    outlier = F.coalesce(F.col("_d") * 0.6745 > F.col("_mad") * threshold, F.lit(False))
    return rows.withColumn(into, outlier).drop("_x", "_m", "_d", "_mad")


def without_outliers(df: DataFrame, by: list[str], values: list[str], threshold: float, logarithm: bool = False) -> DataFrame:
    """Rows that are no outlier in any of the value columns, each judged on all rows. The rows are written once, being read several times."""
    columns = df.columns
    df = Scratch(df.sparkSession, "outliers").cut(df)
    masks = []
    for i, v in enumerate(values):
        df = mad_mask(df, by, v, threshold, f"_out{i}", logarithm)
        masks.append(f"_out{i}")
    return df.where(~F.greatest(*masks, F.lit(False)) if len(masks) > 0 else F.lit(True)).select(*columns)


def weighted_chunks(df: DataFrame, key: str, weights: list[float], into: str) -> DataFrame:
    """df with a chunk number 0.. for every row, by the hash of its key, chunks having about their share of the weights."""
    total, upto, number = sum(weights), 0.0, F.lit(len(weights) - 1)
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    cuts = []
    for w in weights[:-1]:
        upto += w / total
        cuts.append(upto)
    for i, c in reversed(list(enumerate(cuts))):
        number = F.when(place < c, F.lit(i)).otherwise(number)
    return df.withColumn(into, number)


def outlier_report(df: DataFrame, by: list[str], value: str, threshold: float, shown: list[str], scored: Column | None = None, least: int = 0) -> DataFrame:
    """The shown columns of the outliers of a value and, unless ``scored`` is None, of the rows of groups with fewer than ``least``
    rows for which it holds. The report only: such groups are no outliers for without_outliers."""
    df = Scratch(df.sparkSession, "outliers").cut(df)
    marked = mad_mask(df, by, value, threshold, "_out")
    if scored is not None:
        few = df.groupBy(*by).agg(F.count_if(scored).alias("_scored"))
        marked = (null_safe_join(marked, few, by) if by else beside(marked, few)).withColumn("_out", F.col("_out") | (F.col("_scored") < least)).drop("_scored")
    return marked.where("_out").select(*shown)


def matching_columns(df: DataFrame, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and the columns whose name a regular expression finds, in the order of the table."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in keep or re.search(pattern, c)])


def ratio_columns(df: DataFrame, pattern: str, by: str, suffix: str = "_ratio") -> DataFrame:
    """df with <column><suffix> = column / by for every column whose name matches; null where ``by`` is 0 or null."""
    return df.select("*", *[F.try_divide(F.col(f"`{c}`"), F.col(by)).alias(f"{c}{suffix}") for c in df.columns if re.search(pattern, c)])


def scored_ratio(df: DataFrame, by: list[str], scored: Column) -> DataFrame:
    """Per group the share of rows for which ``scored`` holds: by..., n_total, n_scored, ratio."""
    return df.groupBy(*by).agg(F.count("*").alias("n_total"), F.count_if(scored).alias("n_scored")).withColumn("ratio", F.col("n_scored") / F.col("n_total"))


def well_scored(df: DataFrame, by: list[str], scored: Column, least: float) -> tuple[DataFrame, DataFrame]:
    """(scored rows of groups whose ratio is above least, ratios of the other groups)."""
    ratios = scored_ratio(df, by, scored)
    good = ratios.where(F.col("ratio") > least).select(*by)
    return null_safe_join(df.where(scored), good, by, "left_semi"), ratios.where(F.col("ratio") <= least)


def uniform_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> list[str]:
    """Columns that hold one value in all rows; nulls and NaN count as differing. One pass over the data, a few bytes back."""
    names = [c for c in df.columns if c not in keep]
    if not names:
        return []
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    aggs = []
    for i, c in enumerate(names):
        bad = F.col(f"`{c}`").isNull() | (F.isnan(f"`{c}`") if c in numeric else F.lit(False))
        aggs += [F.min(f"`{c}`").alias(f"lo{i}"), F.max(f"`{c}`").alias(f"hi{i}"), F.count_if(bad).alias(f"bad{i}")]
    row = df.agg(F.count("*").alias("n"), *aggs).first()
    return [c for i, c in enumerate(names) if row["n"] and not row[f"bad{i}"] and row[f"lo{i}"] == row[f"hi{i}"]]


def drop_uniform(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.drop(*uniform_columns(df, keep))


def select_in_order(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist, in the order of the table."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in set(wanted)])


def drop_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without null or NaN in the columns (all by default)."""
    return df.dropna("any", subset=columns)
