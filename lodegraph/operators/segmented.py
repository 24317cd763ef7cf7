"""Running totals per key that do not put one key into one task.

A plain window over a key that owns a third of all rows runs in a single
task. Here the key is cut into segments of its order column: each segment
computes its own running total, and only one short row per segment passes
through the window over the whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column,
                  value: Column, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` up to and including each row.

    `order` has to be total within a key and `segment` monotonic in it.
    """
    rows = df.withColumn("_seg", segment).withColumn("_val", value.cast("long"))
    inside = Window.partitionBy(*keys, "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(*keys, "_seg").agg(F.sum("_val").alias("_sum"))
        .withColumn("_carry", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .drop("_sum")
    )
    local = rows.withColumn("_local", F.sum("_val").over(inside))
    return (
        local.join(carried, [*keys, "_seg"])
        .withColumn(name, F.col("_carry") + F.col("_local"))
        .drop("_seg", "_val", "_local", "_carry")
    )


def running_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column,
                 name: str) -> DataFrame:
    """Adds `name`: 1, 2, 3 … within each key in the given order."""
    return running_total(df, keys, order, segment, F.lit(1), name)
