"""Top-N per group and first-of-group, both reduced before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                  rank: str = "rank") -> DataFrame:
    """The first `n` rows of each group.

    The filter on row_number lets Spark keep only n rows per group and task
    ahead of the exchange (WindowGroupLimit), so a hot group stays small.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def top_rows(df: DataFrame, order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first `n` rows overall, numbered from 1. `n` is a request parameter."""
    best = df.orderBy(*order).limit(n)
    return best.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per group, the smallest by `order` (ascending, no nulls).

    An aggregate rather than a window: copies fold together map-side, so a
    group of copies holding a third of the rows costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = df.select(*keys, F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)]).alias("_o"),
                       F.struct(*rest).alias("_r"))
    best = packed.groupBy(*keys).agg(F.min_by("_r", "_o").alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*df.columns)


def ordered_collect(order: Sequence[Column], value: Column) -> Column:
    """Array of `value` in the given ascending order, for groups already cut to size."""
    packed = F.sort_array(F.collect_list(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], value.alias("_v"))))
    return F.transform(packed, lambda s: s["_v"])
