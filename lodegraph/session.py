"""Session settings shared by the jobs, the tests and the benchmark."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings that help at any size. Parallelism is deliberately absent: a cluster
# sets it for itself and adaptive execution merges or splits from there.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # lists of keys reach the Parquet reader as they are
    "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
    # call sites are looked up per expression otherwise, which slows planning
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  memory: str = "8g", app: str = "lodegraph") -> SparkSession:
    """A session for one machine (tests, benchmark, command line)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def job_session(app: str = "lodegraph") -> SparkSession:
    """The session of a submitted job: its cluster if one is named, else this machine."""
    SparkContext._ensure_initialized()
    if not SparkConf().contains("spark.master"):
        return local_session(app=app)
    builder = SparkSession.builder.appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a fresh local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="run-lodegraph-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` on reliable storage, so that lost executors cost nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# rows, some 100 bytes each, up to which a side of a join is broadcast
BROADCAST_ROWS = 50_000


def side(df: DataFrame) -> DataFrame:
    """`df` as a side of a join: broadcast if its rows are counted to be few, merged otherwise.

    All that is known of a plan's size may be that of compressed files, which
    hold many more rows than a driver can broadcast.
    """
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.hint("merge")


# rows that one task sorts or groups at once, some 360 bytes of memory each
TASK_ROWS = 1_000_000


def dealt(df: DataFrame, rows: int, *keys: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """`df` dealt by hash of `keys` to parts of about `task_rows`, if `rows` are more than the shuffle's own parts hold so.

    The number of a shuffle's parts is fixed, so without this a task's memory grows with the input.
    Both sides of a join are dealt by the same `rows`.
    """
    parts = -(-rows // task_rows)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, read back.

    For rounds: unlike a checkpoint it hands no constraints of its plan on to the next.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession) -> None:
    """Lets the shuffle files of finished steps go.

    Spark removes them when the driver happens to collect its garbage, which may be never; until then the disk
    holds those of all steps, not those of the largest one.
    """
    gc.collect()
    spark._jvm.System.gc()
