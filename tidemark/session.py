"""Session helpers: a local session for tests and bench, and reliable cut points."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "16g", app: str = "tidemark") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and saved models.

    The cluster names it in ``spark.checkpoint.dir``; a cluster without it is an error, as executors
    do not see each other's disks.  Only a session in one process (master ``local``) that names none gets
    a temporary folder of its own, remembered in the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidemark.shared.dir", None)
    if not path:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("tidemark.shared.dir", path)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(path)
    return path


#: How written tables are compressed: with feature rows and ledgers it takes about a third less than the default.
CODEC = "zstd"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from there.

    Used where several fits or branches read the same table: the work before the cut runs once, a
    lost executor costs a re-read instead of a recomputation, and later reads prune columns.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "cut")
    df.write.option("compression", CODEC).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Whether Spark removes the shuffle files of a query when it ends; otherwise they stay until the driver collects garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Queries inside the block give their shuffle files back when they end, as with a row of cuts nothing reads them again."""
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(RELEASE)
        else:
            spark.conf.set(RELEASE, before)


_OWNERS: list[list[str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = os.path.join(shared_dir(spark), f"{name}-{os.urandom(6).hex()}")
    if _OWNERS:
        _OWNERS[-1].append(path)
    return path


@contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that were cut inside the block once it ends; results must be read or written by then."""
    paths: list[str] = []
    _OWNERS.append(paths)
    try:
        yield
    finally:
        _OWNERS.remove(paths)
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(hadoop).delete(place, True)
