"""Keyed writes as plans over whole tables: existing rows in, new table out.

Existing and incoming rows are pooled and reduced by key in one shuffle. The
reduction starts map-side, so a key that arrives a million times in a batch
costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pack(columns: Sequence[str]) -> Column:
    return F.struct(*columns) if columns else F.struct(F.lit(None).cast("int").alias("_none"))


def _pooled(existing: DataFrame, incoming: DataFrame, order: str | None) -> DataFrame:
    """Both sides with `_new` and `_seq`, the place of a row within its batch."""
    kind = incoming.schema[order].dataType if order else "int"
    old = existing.withColumn("_new", F.lit(0)).withColumn("_seq", F.lit(None).cast(kind))
    new = incoming.withColumn("_seq", F.col(order) if order else F.lit(None).cast(kind)).withColumn("_new", F.lit(1))
    if order and order not in existing.columns:
        new = new.drop(order)
    return old.unionByName(new, allowMissingColumns=True)


def split(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows a batch touches, all others)."""
    named = incoming.select(*keys).distinct()
    return existing.join(named, list(keys), "left_semi"), existing.join(named, list(keys), "left_anti")


def overwrite(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Incoming attributes replace existing ones, nulls included; attributes
    the batch does not carry stay. Within a batch the last row by `order` wins."""
    replaced = [c for c in incoming.columns if c not in keys and c != order]
    kept = [c for c in existing.columns if c not in keys and c not in replaced]
    rows = _pooled(existing, incoming, order)
    latest = F.struct("_new", "_seq")
    merged = rows.groupBy(*keys).agg(
        F.max_by(_pack(replaced), latest).alias("_r"),
        F.any_value(F.when(F.col("_new") == 0, _pack(kept)), F.lit(True)).alias("_k"),
    )
    columns = [*existing.columns, *[c for c in replaced if c not in existing.columns]]
    return merged.select(*[
        F.col(c) if c in keys else F.col("_r")[c].alias(c) if c in replaced else F.col("_k")[c].alias(c)
        for c in columns
    ])


def create_only(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], fill: Sequence[str] = (),
                order: str | None = None) -> DataFrame:
    """Existing nodes stay as they are, unseen keys are created from their first
    row; columns in `fill` take the first non-null value ever offered."""
    columns = [c for c in dict.fromkeys([*existing.columns, *incoming.columns]) if c != order or c in existing.columns]
    fixed = [c for c in columns if c not in keys and c not in fill]
    rows = _pooled(existing, incoming, order)
    first = F.struct("_new", "_seq")
    merged = rows.groupBy(*keys).agg(
        F.min_by(_pack(fixed), first).alias("_f"),
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), first)).alias(c) for c in fill],
    )
    return merged.select(*[F.col("_f")[c].alias(c) if c in fixed else F.col(c) for c in columns])


def edges(existing: DataFrame, incoming: DataFrame, src: DataFrame, dst: DataFrame,
          keys: Sequence[str] = ("src_id", "dst_id"), order: str | None = None) -> DataFrame:
    """Edge upsert. Rows whose endpoints do not both exist are dropped; `src`
    and `dst` are one-column frames of node keys. The last row's properties win."""
    valid = incoming.join(src.toDF("src_id"), "src_id", "left_semi").join(dst.toDF("dst_id"), "dst_id", "left_semi")
    return overwrite(existing, valid, keys, order)


def counted_edges(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("src_id", "dst_label", "dst_id"),
                  order: str = "seq") -> DataFrame:
    """Mention edges: `count` grows by one per incoming row, every other
    property is that of the last one."""
    props = [c for c in existing.columns if c not in keys and c != "count"]
    old = existing.select(*keys, F.col("count").cast("long").alias("count"), _pack(props).alias("_p"),
                          F.struct(F.lit(0).alias("n"), F.lit(None).cast(incoming.schema[order].dataType).alias("s")).alias("_o"))
    new = incoming.select(*keys, F.lit(1).cast("long").alias("count"), _pack(props).alias("_p"),
                          F.struct(F.lit(1).alias("n"), F.col(order).alias("s")).alias("_o"))
    merged = old.unionByName(new).groupBy(*keys).agg(F.sum("count").alias("count"), F.max_by("_p", "_o").alias("_p"))
    return merged.select(*[F.col("_p")[c].alias(c) if c in props else F.col(c) for c in existing.columns])


def added_counts(left: DataFrame, *parts: DataFrame, keys: Sequence[str] = ("src_id", "dst_label", "dst_id")) -> DataFrame:
    """Edges of all tables with their counts added; other properties are those last extracted or loaded."""
    props = [c for c in left.columns if c not in keys and c != "count"]
    stamp = F.struct(F.coalesce("extracted_at", "loaded_at", F.lit("")).alias("at"), F.coalesce("source", F.lit("")).alias("source"))
    pooled = reduce(DataFrame.unionByName, [p.select(left.columns) for p in parts], left)
    summed = pooled.groupBy(*keys).agg(F.sum("count").alias("count"), F.max_by(_pack(props), stamp).alias("_p"))
    return summed.select(*[F.col("_p")[c].alias(c) if c in props else F.col(c) for c in left.columns])


def chunks(existing: DataFrame, incoming: DataFrame, key: str = "id", text: str = "text",
           embedding: str = "embedding") -> DataFrame:
    """Chunk upsert: a chunk whose text changed loses its embedding."""
    carried = [c for c in existing.columns if c != key and c not in incoming.columns and c != embedding]
    replaced = [c for c in incoming.columns if c != key]
    old = existing.select(key, F.col(text).alias("_old_text"), F.col(embedding).alias("_old_embedding"),
                          *[F.col(c).alias(f"_old_{c}") for c in replaced if c != text and c in existing.columns], *carried)
    new = incoming.withColumn("_arrived", F.lit(True))
    joined = old.join(new, key, "full")
    arrived = F.coalesce("_arrived", F.lit(False))

    def value(c: str) -> Column:
        if c == key or c in carried:
            return F.col(c)
        if c == embedding:
            return F.when(~arrived | (F.col("_old_text") == F.col(text)), F.col("_old_embedding")).alias(c)
        before = F.col(f"_old_{c}") if c in existing.columns else F.lit(None)
        return F.when(arrived, F.col(c)).otherwise(before).alias(c)

    return joined.select(*[value(c) for c in existing.columns])


def without(existing: DataFrame, keys: DataFrame, on: str = "id") -> DataFrame:
    """Rows whose key is not among the given ones (deletion, and resume filters)."""
    return existing.join(keys, on, "left_anti")
