"""Exact quantiles per group that no single reducer has to hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posemill.operators.joins import null_safe_join

HOT_ROWS = 1_000_000


def group_quantiles(df: DataFrame, by: list[str], value: str | Column, quantiles: dict[str, float], hot_rows: int = HOT_ROWS) -> DataFrame:
    """by... and one column per quantile (name -> share), interpolated linearly between the two ranks next to (n-1) x share.

    Groups of at most ``hot_rows`` values are aggregated as they are. The values of larger ones, or of a table without groups, are
    counted and ranked in ranges (ranking.distinct_ranks), and only the values at the wanted ranks are gathered. Nulls and NaN do not
    count; a group without values has nulls; null keys are a group.
    """
    from posemill.operators.ranking import distinct_ranks

    raw = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(*by, F.when(~F.isnan(raw), raw).alias("_q"))
    small = [F.percentile("_q", float(s)).alias(n) for n, s in quantiles.items()]
    sizes = rows.groupBy(*by).agg(F.count("_q").alias("_n")).where(F.col("_n") > hot_rows)
    if not sizes.limit(1).count():
        return rows.groupBy(*by).agg(*small)
    hot = sizes.select(*by)
    inside = null_safe_join(rows, hot, by, "left_semi") if by else rows
    ranks = distinct_ranks(inside, "_q", by)
    first, last = F.col("_before"), F.col("_before") + F.col("_ties") - 1
    place = {n: (F.col("_total") - 1) * float(s) for n, s in quantiles.items()}
    wanted = reduce(lambda a, b: a | b, [(first <= F.ceil(p)) & (last >= F.floor(p)) for p in place.values()])
    ends = []
    for n, p in place.items():
        ends += [F.max(F.when((first <= F.floor(p)) & (last >= F.floor(p)), F.col("_q"))).alias(f"{n}_lo"), F.max(F.when((first <= F.ceil(p)) & (last >= F.ceil(p)), F.col("_q"))).alias(f"{n}_hi")]
        ends.append(F.max(p - F.floor(p)).alias(f"{n}_at"))
    gathered = ranks.where(wanted).groupBy(*by).agg(*ends)
    large = gathered.select(*by, *[(F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_at")).alias(n) for n in quantiles])
    if not by:
        return large
    return null_safe_join(rows, hot, by, "left_anti").groupBy(*by).agg(*small).unionByName(large)
