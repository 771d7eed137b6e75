"""Scaling, discretisation and fusion of columns. Constant columns scale to 0; nulls and NaN stay as null."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posemill.operators.joins import beside, null_safe_join
from posemill.operators.quantiles import group_quantiles


def _clean(c: str) -> Column:
    x = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(x), x)


def _apply(df: DataFrame, columns: list[str], by: list[str], stats: dict[str, tuple[Column, Column]]) -> DataFrame:
    aggs = [a.alias(f"_{k}{i}") for i, c in enumerate(columns) for k, a in zip("ms", stats[c], strict=True)]
    both = null_safe_join(df, df.groupBy(*by).agg(*aggs), by) if by else beside(df, df.agg(*aggs))
    done = {c: F.coalesce(F.try_divide(_clean(c) - F.col(f"_m{i}"), F.col(f"_s{i}")), _clean(c) * 0) for i, c in enumerate(columns)}
    return both.select(*[done[c].alias(c) if c in done else F.col(f"`{c}`") for c in df.columns])


def minmax(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(x - min)/(max - min), over the table or per group."""
    return _apply(df, columns, by or [], {c: (F.min(_clean(c)), F.max(_clean(c)) - F.min(_clean(c))) for c in columns})


def standardize(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(x - mean)/population deviation, over the table or per group."""
    return _apply(df, columns, by or [], {c: (F.avg(_clean(c)), F.stddev_pop(_clean(c))) for c in columns})


def feature_columns(df: DataFrame) -> list[str]:
    """Columns that are features by their name: no ``name`` in it, not structvar, protein or is_active."""
    return [c for c in df.columns if "name" not in c and c not in ("structvar", "protein", "is_active")]


def standardize_composed(df: DataFrame, columns: list[str], protein: str) -> DataFrame:
    """All columns over the table, then per protein those that end in _Eint or speak of protein or complex; no missing values left."""
    special = [c for c in columns if c.endswith("_Eint") or "protein" in c or "complex" in c]
    whole = standardize(df, columns)
    return (standardize(whole, special, [protein]) if special else whole).dropna("any", subset=columns)


def auto_bins(df: DataFrame, column: str) -> tuple[float, float, int] | None:
    """Lowest and highest edge and number of equal bins, by the smaller width of Sturges' and Freedman-Diaconis' rules; one row of statistics
    comes back. None without values."""
    c = _clean(column)
    quarters = group_quantiles(df, [], c, {"q1": 0.25, "q3": 0.75}).select((F.col("q3") - F.col("q1")).alias("iqr"))
    r = beside(df.agg(F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")), quarters).first()
    if not r["n"]:
        return None
    if r["lo"] == r["hi"]:
        return r["lo"] - 0.5, r["hi"] + 0.5, 1
    width = min(x for x in ((r["hi"] - r["lo"]) / (log2(r["n"]) + 1), 2 * r["iqr"] / r["n"] ** (1 / 3)) if x > 0)
    return r["lo"], r["hi"], max(1, ceil((r["hi"] - r["lo"]) / width))


def auto_edges(df: DataFrame, column: str) -> list[float]:
    """The edges of auto_bins as a list. A few far values make as many of them as there are rows, so rows are better put in bins by discretize_auto."""
    found = auto_bins(df, column)
    if not found:
        return []
    low, high, bins = found
    return [low + (high - low) * i / bins for i in range(bins + 1)]


def fixed_edges(low: float, high: float, width: float, centred: bool = False) -> list[float]:
    start = low - width / 2 if centred else low
    n = max(1, int(-(-(high - start) // width)))
    return [start + width * i for i in range(n + 1)]


def discretize(df: DataFrame, column: str, edges: list[float], into: str) -> DataFrame:
    """Number of edges at or below the value: 0 below all, len(edges) from the last on; null for missing values."""
    c = _clean(column)
    bin_ = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= c)) if edges else F.lit(0)
    return df.withColumn(into, F.when(c.isNotNull(), bin_))


def discretize_equal(df: DataFrame, column: str, low: float, high: float, bins: int, into: str) -> DataFrame:
    """discretize for the edges low + (high - low) i / bins, i = 0 to bins, which are never listed.

    They grow with i as rounded, too, so each row halves its way to the last edge at or below the value; steps grow with the logarithm of bins.
    """
    c = _clean(column)
    steps = F.array(*[F.lit(1 << i).cast("long") for i in reversed(range((bins + 1).bit_length()))])
    edge = lambda i: F.lit(float(low)) + F.lit(float(high) - float(low)) * i / F.lit(float(bins))
    further = lambda n, step: F.when((n + step <= bins + 1) & (edge((n + step - 1).cast("double")) <= c), n + step).otherwise(n)
    return df.withColumn(into, F.when(c.isNotNull(), F.aggregate(steps, F.lit(0).cast("long"), further).cast("int")))


def discretize_auto(df: DataFrame, column: str, into: str) -> DataFrame:
    """discretize for the edges of auto_bins, however many they are."""
    found = auto_bins(df, column)
    return discretize_equal(df, column, *found, into) if found else discretize(df, column, [], into)


def fuse(columns: list[str], how: str) -> Column:
    """Row-wise fusion of scores: min, sum (the "mean rank"), geo, harm; missing values are skipped, null if all are.

    geo and harm need n = number of columns, not of values present.
    """
    cs = [_clean(c) for c in columns]
    some = F.coalesce(*cs).isNotNull()
    n = len(columns)
    if how == "min":
        return F.least(*cs) if n > 1 else cs[0]
    if how == "sum":
        return F.when(some, sum((F.coalesce(c, F.lit(0.0)) for c in cs[1:]), F.coalesce(cs[0], F.lit(0.0))))
    if how == "geo":
        product = F.lit(1.0)
        for c in cs:
            product = product * F.coalesce(c, F.lit(1.0))
        return F.when(some & (product >= 0), F.pow(product, F.lit(1.0 / n)))
    if how == "harm":
        total = F.lit(0.0)
        for c in cs:
            total = total + F.coalesce(F.try_divide(F.lit(1.0), c), F.lit(0.0))
        return F.when(some, F.try_divide(F.lit(1.0), total / n))
    raise ValueError(f"unknown fusion {how}")


def shifted_log(df: DataFrame, column: str, into: str) -> DataFrame:
    """ln(x - min + 1) with the table's minimum."""
    low = df.agg(F.min(_clean(column)).alias("_low"))
    return beside(df, low).withColumn(into, F.log(_clean(column) - F.col("_low") + 1)).drop("_low")
