"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: Tables may take so many files, whatever their size. Bytes of text in a file.
LEAST_FILES, FILE_BYTES = 8, 32 << 20


def build_session(app: str = "gistmill", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with AQE, skew-join splitting and UTC; cluster settings stay with spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if current is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current:
        return os.path.dirname(current.rstrip("/"))
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    made = tempfile.mkdtemp(prefix="gistmill-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and keeps loop plans short."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def hold(df: DataFrame) -> DataFrame:
    """A local checkpoint on the disks of two executors, for tables between the steps of one operator: it survives one lost executor. No task writes a
    file through Hadoop, which without its native library starts processes for each that count the whole executor's memory again until they run."""
    return df.localCheckpoint(eager=True, storageLevel=StorageLevel.DISK_ONLY_2)


def few_files(df: DataFrame, size: int, each: int) -> DataFrame:
    """The rows in no more partitions than a table of this size needs at `each` (rows or bytes) a file, before it is written."""
    return df.coalesce(max(LEAST_FILES, math.ceil(size / each)))


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows as a Parquet table in the shared folder: smaller than a checkpoint, and readers fetch only the columns they need."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
