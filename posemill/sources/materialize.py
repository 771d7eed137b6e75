"""Results kept under a fingerprint of their settings, and side outputs."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def fingerprint(settings: object) -> str:
    """Hash of all settings of a frozen dataclass or dict, whatever the order of its keys."""
    plain = dataclasses.asdict(settings) if dataclasses.is_dataclass(settings) else settings
    return hashlib.sha256(json.dumps(plain, sort_keys=True, default=str).encode()).hexdigest()[:16]


def materialize(spark: SparkSession, folder: str, name: str, settings: object, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The stored result of ``make`` for these settings; made and written as Parquet if absent or ``force``.

    A result counts as stored only once its _SUCCESS marker is there, so a run that was lost half-way is made again.
    """
    path = f"{folder}/{name}-{fingerprint(settings)}"
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if force or not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_side_output(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_single_csv(df: DataFrame, path: str) -> None:
    """One gzipped CSV with a header, for small reports that other tools read."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)
