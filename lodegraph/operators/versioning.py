"""Versioned conclusions: changed facts are archived, not overwritten."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.session import cut_lineage


def differs(new, old) -> Column:
    """Text or confidence changed (a null on either side is no change), or the
    geography did, absent counting as empty."""
    changed = F.coalesce(new["text"] != old["text"], F.lit(False)) | F.coalesce(
        new["confidence"] != old["confidence"], F.lit(False))
    place = F.coalesce(new["geography"], F.lit("")) != F.coalesce(old["geography"], F.lit(""))
    return changed | place


STATE = ("text", "confidence", "geography")
LAYOUT = pa.schema([
    ("id", pa.string()), ("version", pa.int32()), ("text", pa.string()), ("confidence", pa.float64()), ("geography", pa.string()),
    ("needs_review", pa.bool_()), ("date", pa.date32()), ("stamp", pa.string()), ("archived", pa.bool_()), ("model", pa.string()),
])


def sort_key(place: dict | str | None) -> list:
    """Nulls first, then by value, field by field."""
    values = place.values() if isinstance(place, dict) else [place]
    return [(v is not None, v) for v in values]


def apply_batch(current: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new current table, archived versions) for one row per conclusion id.

    Unchanged conclusions keep everything; changed ones take the new state, a
    higher version and the batch's time, and their old state is archived.
    Needs incoming (id, text, confidence, geography, date, needs_review, now, model).
    """
    new = F.struct(*STATE, "needs_review", "date", "now", "model")
    old = F.struct(*[c for c in current.columns if c != "id"])
    joined = current.select("id", old.alias("old")).join(incoming.select("id", new.alias("new")), "id", "full")
    both = F.col("old").isNotNull() & F.col("new").isNotNull()
    changed = both & differs(F.col("new"), F.col("old"))
    version = F.coalesce(F.col("old.version"), F.lit(1))

    def value(c: str) -> Column:
        created = {
            "version": F.lit(1), "updated_at": F.col("new.now"),
            **{k: F.col(f"new.{k}") for k in (*STATE, "needs_review", "date")},
        }.get(c, F.lit(None))
        moved = {
            "version": version + 1, "updated_at": F.col("new.now"),
            **{k: F.col(f"new.{k}") for k in (*STATE, "needs_review")},
        }.get(c, F.col(f"old.{c}"))
        return F.when(F.col("old").isNull(), created).when(changed, moved).otherwise(F.col(f"old.{c}")) \
            .cast(current.schema[c].dataType).alias(c)

    after = joined.select(*["id" if c == "id" else value(c) for c in current.columns])
    archived = joined.where(changed).select(
        F.col("id").alias("conclusion_id"), version.alias("version"), *[F.col(f"old.{c}").alias(c) for c in STATE],
        F.col("new.now").alias("archived_at"), F.col("new.model").alias("archived_by_model"),
    )
    return after, archived


VERSIONED = (
    "id string, version int, text string, confidence double, geography string, needs_review boolean, date date, "
    "stamp string, archived boolean, model string"
)


def apply_changes(current: DataFrame, incoming: DataFrame, order: Column) -> tuple[DataFrame, DataFrame]:
    """Like `apply_batch` for any number of rows per conclusion id, taken by `order`.

    The result is that of as many batches of one row each. Rows whose `now` is
    not after the stored state are left out, so repeating a batch changes
    nothing. The rows of an id in one batch are walked by one task; the batch,
    not the table, bounds them.
    """
    old = F.struct("version", *STATE, "needs_review", "date", "updated_at")
    before = current.select("id", old.alias("old"))
    asked = incoming.select(
        "id", F.struct(order.alias("place"), *STATE, "needs_review", "date", "now", "model").alias("new")
    ).join(before, "id", "left").where("old.updated_at is null or new.now > old.updated_at")

    def walk(group):
        rows = sorted(zip(group.column("new").to_pylist(), group.column("old").to_pylist()), key=lambda r: sort_key(r[0]["place"]))
        state, out = rows[0][1], []
        key = group.column("id")[0].as_py()
        for new, _ in rows:
            if state is None:
                state = {**{c: new[c] for c in (*STATE, "needs_review", "date")}, "version": 1, "updated_at": new["now"]}
                continue
            text, sure = ((new[c], state[c]) for c in STATE[:2])
            moved = any(a is not None and b is not None and a != b for a, b in (text, sure))
            if not moved and (new["geography"] or "") == (state["geography"] or ""):
                continue
            version = state["version"] or 1
            out.append((version, state, new["now"], True, new["model"]))
            state = {**state, **{c: new[c] for c in (*STATE, "needs_review")}, "version": version + 1, "updated_at": new["now"]}
        out.append((state["version"], state, state["updated_at"], False, None))
        return pa.Table.from_pylist([
            {"id": key, "version": version, **{c: s[c] for c in (*STATE, "needs_review", "date")}, "stamp": stamp,
             "archived": archived, "model": model}
            for version, s, stamp, archived, model in out
        ], schema=LAYOUT)

    walked = cut_lineage(asked.groupBy("id").applyInArrow(walk, VERSIONED))
    archived = walked.where("archived").select(
        F.col("id").alias("conclusion_id"), "version", *STATE, F.col("stamp").alias("archived_at"), F.col("model").alias("archived_by_model"))
    last = walked.where("not archived").select(F.col("id").alias("_id"), *[
        F.col(c).alias(f"_{c}") for c in ("version", *STATE, "needs_review", "date", "stamp")])
    joined = current.join(last, F.col("id") == F.col("_id"), "full")
    took = {"updated_at": "_stamp", **{c: f"_{c}" for c in ("version", *STATE, "needs_review", "date")}}

    def value(c: str) -> Column:
        new = F.coalesce("id", "_id") if c == "id" else F.when(F.col("_id").isNotNull(), F.col(took[c])).otherwise(F.col(c)) if c in took else F.col(c)
        return new.cast(current.schema[c].dataType).alias(c)

    return joined.select(*[value(c) for c in current.columns]), archived


def replay(history: DataFrame, key: str, order: Sequence[str], segment: Column) -> DataFrame:
    """Numbers the versions of a whole change log at once.

    Adds `version` (1 at the start, one more at each change) and `changed`
    (null on the first row). The log of one key may be most of the table, so
    it is cut into segments: versions inside a segment come from a window over
    the segment, and only each segment's first and last state and number of
    changes go through the window over the key.
    """
    at = F.struct(*STATE)
    inside = Window.partitionBy(key, "_seg").orderBy(*order)
    rows = (
        history.withColumn("_seg", segment).withColumn("_at", at)
        .withColumn("_prev", F.lag("_at").over(inside))
        .withColumn("_change", F.col("_prev").isNotNull() & differs(F.col("_at"), F.col("_prev")))
        .withColumn("_inside", F.sum(F.col("_change").cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    )
    place = F.struct(*order)
    summary = (
        history.withColumn("_seg", segment).withColumn("_at", at)
        .withColumn("_prev", F.lag("_at").over(inside))
        .withColumn("_change", F.col("_prev").isNotNull() & differs(F.col("_at"), F.col("_prev")))
        .groupBy(key, "_seg").agg(
            F.min_by("_at", place).alias("_first"), F.max_by("_at", place).alias("_last"),
            F.sum(F.col("_change").cast("long")).alias("_changes"))
    )
    along = Window.partitionBy(key).orderBy("_seg")
    carried = (
        summary.withColumn("_before", F.lag("_last").over(along))
        .withColumn("_joint", F.col("_before").isNotNull() & differs(F.col("_first"), F.col("_before")))
        .withColumn("_carry", F.sum(F.col("_changes") + F.col("_joint").cast("long")).over(along) - F.col("_changes"))
        .select(key, "_seg", "_before", "_joint", "_carry")
    )
    opening = F.col("_prev").isNull()
    return (
        rows.join(carried, [key, "_seg"])
        .withColumn("version", F.lit(1) + F.col("_carry") + F.col("_inside"))
        .withColumn("changed", F.when(opening & F.col("_before").isNull(), F.lit(None))
                    .when(opening, F.col("_joint")).otherwise(F.col("_change")))
        .drop("_seg", "_at", "_prev", "_change", "_inside", "_before", "_joint", "_carry")
    )
