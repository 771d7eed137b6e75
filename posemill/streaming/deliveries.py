"""Streams of delivered scores: live counts per window and the best pose so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def score_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 4) -> DataFrame:
    """Parquet files that arrive in a folder, read as a stream under a fixed schema."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def delivery_counts(stream: DataFrame, at: str, by: list[str], length: str = "1 day", late: str = "7 days") -> DataFrame:
    """Rows, scored rows and lowest score per time window and group; rows later than the watermark are dropped."""
    return (
        stream.withWatermark(at, late).groupBy(F.window(at, length), *by)
        .agg(F.count("*").alias("n_rows"), F.count("score").alias("n_scored"), F.min("score").alias("lowest"))
        .select(F.col("window.start").alias("from"), *by, "n_rows", "n_scored", "lowest")
    )


def first_deliveries(stream: DataFrame, keys: list[str], at: str, late: str = "7 days") -> DataFrame:
    """Each key once per watermark span; state of older keys is dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def running_best(stream: DataFrame, by: list[str], score: str, carried: list[str]) -> DataFrame:
    """The row of lowest score per group so far (update mode); ties go by the carried columns."""
    best = F.min(F.struct(F.col(score), *carried))
    return stream.where(F.col(score).isNotNull()).groupBy(*by).agg(best.alias("best")).select(*by, "best.*")
