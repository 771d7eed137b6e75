"""Mergeable percentiles with bounded relative error: counts in signed logarithmic buckets."""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_INF = 1 << 30


def _gamma(error: float) -> float:
    return (1 + error) / (1 - error)


def log_sketch(rows: DataFrame, by: list[str], value: str, error: float = 0.01) -> DataFrame:
    """Counts per group and bucket: by..., bucket, n. Bucket +-(i + 2**20) holds gamma**(i-1) < \\|x\\| <= gamma**i, 0 the zeros.

    Sketches of partitions, days or files are combined with merge_sketches; no value is kept, and a group has at most
    2 x 1420/log(gamma) buckets, whatever it counts. Aggregation is partial before its shuffle, so a group with a third of
    all rows sends at most one row per bucket and partition.

    Defined cases: null and NaN values are not counted, a null key is a group; infinities have buckets of their own;
    an empty table gives no rows.
    """
    x = F.col(value).cast("double")
    index = F.ceil(F.log(F.abs(x)) / F.lit(log(_gamma(error)))).cast("int") + F.lit(1 << 20)
    bucket = (
        F.when(x == 0, 0).when(x == float("inf"), _INF).when(x == float("-inf"), -_INF)
        .otherwise(F.signum(x).cast("int") * index)
    )
    return rows.where(x.isNotNull() & ~F.isnan(x)).groupBy(*by, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Add matching bucket counts; ``by`` may be coarser than the sketches' own groups."""
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def sketch_percentiles(sketch: DataFrame, by: list[str], shares: list[float], error: float = 0.01) -> DataFrame:
    """by..., n_values, share, estimate. The value of rank floor(share*(n-1)) x is met within error*\\|x\\|.

    Works on the bounded buckets of each group only. ``error`` must be the one the sketch was made with.
    """
    gamma = _gamma(error)
    order = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    b = F.col("bucket")
    middle = F.pow(F.lit(gamma), F.abs(b) - (1 << 20)) * 2 / (gamma + 1)
    value = F.when(b == 0, 0.0).when(b == _INF, float("inf")).when(b == -_INF, float("-inf")).otherwise(F.signum(b) * middle)
    counted = sketch.withColumn("upto", F.sum("n").over(order)).withColumn("n_values", F.sum("n").over(whole))
    wanted = counted.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    rank = F.floor(F.col("share") * (F.col("n_values") - 1))
    return wanted.where((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n"))).select(*by, "n_values", "share", value.alias("estimate"))
