"""Coverage of every material by every process.

The dense matrix has |materials| x |processes| cells by definition; the
product to keep is the sparse table of counted pairs. Where cells or gaps are
asked for, the processes come as arrays of bounded length, one per bucket: as
a broadcast while they are few, beyond that in copies by a hash of the
material, so that no bucket's rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.session import TASK_ROWS, dealt

BUCKET_SIZE = 1024
# keys, some 30 bytes each, up to which their arrays are broadcast; copies of an array beyond
BROADCAST_KEYS, COPIES = 50_000, 64


def _by_bucket(left: DataFrame, right: DataFrame, counts: DataFrame, bucket_size: int,
               broadcast_keys: int = BROADCAST_KEYS, task_rows: int = TASK_ROWS) -> DataFrame:
    """(left_key, ..., keys[], seen): per left row and bucket the counted right keys as a map.

    Further columns of `left` come along. Maps and rows meet in tasks of about `task_rows` cells.
    """
    total = right.count()
    cells = left.count() * total
    buckets = max(1, -(-total // bucket_size))
    bucket = lambda key: F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
    arrays = right.groupBy(bucket("key")).agg(F.sort_array(F.collect_set("key")).alias("keys"))
    seen = dealt(counts.select("*", bucket("right_key")), cells, "left_key", "bucket", task_rows=task_rows).groupBy("left_key", "bucket").agg(
        F.map_from_entries(F.collect_list(F.struct("right_key", "docs"))).alias("seen"))
    rows = left.withColumnRenamed("key", "left_key").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    rows = dealt(rows, cells, "left_key", "bucket", task_rows=task_rows).join(seen, ["left_key", "bucket"], "left")
    if total <= broadcast_keys:
        return rows.join(F.broadcast(arrays), "bucket")
    copies = arrays.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    return rows.withColumn("copy", F.pmod(F.xxhash64("left_key"), F.lit(COPIES)).cast("int")).join(copies, ["bucket", "copy"])


def _carried(left: DataFrame) -> list[str]:
    return [c for c in left.columns if c != "key"]


def coverage(left: DataFrame, right: DataFrame, counts: DataFrame, bucket_size: int = BUCKET_SIZE,
             broadcast_keys: int = BROADCAST_KEYS, task_rows: int = TASK_ROWS) -> DataFrame:
    """(left_key, ..., right_key, docs) for every pair, zero where nothing was counted."""
    cells = _by_bucket(left, right, counts, bucket_size, broadcast_keys, task_rows).select(
        "left_key", *_carried(left), "seen", F.explode("keys").alias("right_key"))
    return cells.select(
        "left_key", *_carried(left), "right_key",
        F.coalesce(F.element_at("seen", F.col("right_key")), F.lit(0)).cast("long").alias("docs"),
    )


def gaps(left: DataFrame, right: DataFrame, counts: DataFrame, bucket_size: int = BUCKET_SIZE,
         broadcast_keys: int = BROADCAST_KEYS, task_rows: int = TASK_ROWS) -> DataFrame:
    """(left_key, ..., right_key) of the pairs nothing was counted for.

    Only the missing keys leave the row, so the work follows the gaps found.
    """
    missing = F.array_except("keys", F.coalesce(F.map_keys("seen"), F.array().cast("array<string>")))
    return _by_bucket(left, right, counts, bucket_size, broadcast_keys, task_rows).select(
        "left_key", *_carried(left), F.explode(missing).alias("right_key"))
