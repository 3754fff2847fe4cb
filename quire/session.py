"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
PACKED = "zstd"          # of tables between steps, which are mostly texts: a third less disk than the default


def local_session(app: str = "quire", cores: str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Only a local session may do without one: its
    executors share the driver's disk, so a private folder holds whole tables."""
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quire-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Compute once and cut lineage: a columnar table in the shared folder, so later steps still
    prune columns and see real sizes, and a lost executor costs nothing but its running tasks."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/quire-{uuid.uuid4().hex}"
    df.write.option("compression", PACKED).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to all cores when the scan itself has fewer splits than there are cores.

    A small table in one file would keep one core busy. On a large table, whose scan has plenty of
    splits, this does nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
