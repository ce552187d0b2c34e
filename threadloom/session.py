"""Session helpers: a default session, and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("threadloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("THREADLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor sees, from spark.checkpoint.dir.

    Only where the session names none (local tests) is a temporary one set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = os.environ.get("THREADLOOM_LOCAL_CHECKPOINTS")
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="threadloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            os.environ["THREADLOOM_LOCAL_CHECKPOINTS"] = folder
        folder = f"file://{folder}" if folder.startswith("/") else folder
    return folder.rstrip("/")


_written: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, any executor may be lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.parquet(path)


def discard(spark: SparkSession) -> int:
    """Deletes the tables that this process wrote to the shared folder, once the results that read them have been used; how many."""
    gone = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def parts(spark: SparkSession) -> int:
    """Partitions that keep every core busy, and no fewer than the session's shuffles have."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over all cores where its files make fewer parts than there are cores; a larger table stays as it is read.

    Only for rows that Python reads next: by the hash of a key, so that a part holds the same rows if it is made again.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
