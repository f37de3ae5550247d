"""Session helpers: the checkpoint folder and tables staged in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Only local mode falls back to its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return tempfile.mkdtemp(prefix="docsieve-")


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a frame once and read it back: later actions neither recompute nor need lost executors."""
    path = path or staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a staged table through the file system it was written to."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Texts that one task scores; a task of more would take minutes, however few bytes its rows have when read.
ROWS_PER_TASK = 20_000


def tasks_for(rows: int, least: int) -> int:
    return max(least, -(-rows // ROWS_PER_TASK))


def rows_per_split(scan: DataFrame) -> list[int]:
    return [r["count"] for r in scan.groupBy(F.spark_partition_id().alias("split")).count().collect()]


def spread(scan: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows of a scan over at least as many tasks as there are cores, and few enough of them in each.

    Scoring is CPU-bound, so splits cut by bytes are a poor measure: a small input would leave the cluster idle, and a
    large one in few row groups would have all its rows in few splits. The rows per split are counted, which for a
    table in Parquet reads its footers only; a scan that is spread well enough is returned untouched: no shuffle. Pass a
    plain scan only.
    """
    tasks = tasks or scan.sparkSession.sparkContext.defaultParallelism
    per_split = rows_per_split(scan)
    tasks = tasks_for(sum(per_split), tasks)
    even = scan.rdd.getNumPartitions() >= tasks and max(per_split, default=0) <= ROWS_PER_TASK
    return scan if even else scan.repartition(tasks)
