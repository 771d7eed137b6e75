"""Session, shared scratch tables and table access."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WHOLE_STAGE = "spark.sql.codegen.wholeStage"


def local_session(cores: str = "8", **conf: str) -> SparkSession:
    """Session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("posemill")
        .config("spark.sql.shuffle.partitions", str(conf.pop("shuffle_partitions", 8)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        root = given or tempfile.mkdtemp(prefix="posemill-")
        path = f"{root.rstrip('/')}/posemill-{app}-{uuid.uuid4().hex[:8]}"
        _OWN[app] = path
        if not given:
            atexit.register(shutil.rmtree, root, True)
        elif urlparse(path).scheme in ("", "file"):
            atexit.register(shutil.rmtree, urlparse(path).path, True)
    return _OWN[app]


class Scratch:
    """Tables written to the shared folder to cut lineage. A lost executor costs only a re-read of them."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"
        self.count = 0

    def cut(self, df: DataFrame, files: int | None = None, wide: bool = False) -> DataFrame:
        """Write df and return a scan of what was written. The shuffle files of the write go with its end: nothing reads them again.

        ``wide``: the plan computes on dozens of columns at once. Whole-stage code for these is one method too large for the JVM's compilers, so
        it is planned without.
        """
        self.count += 1
        path = f"{self.root}/{self.count:03d}"
        conf = {_CLEANUP: "true"} | ({_WHOLE_STAGE: "false"} if wide else {})
        before = {k: self.spark.conf.get(k, None) for k in conf}
        try:
            for k, v in conf.items():
                self.spark.conf.set(k, v)
            (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Remove tables that no later plan reads."""
        jvm = self.spark._jvm
        for t in tables:
            path = getattr(t, "_scratch", None)
            if path:
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def ship(module: str) -> None:
    """Send the functions of a module to Python workers by value, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
