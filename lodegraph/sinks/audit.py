"""Append-only audit log: one JSON object per action, in batches by day."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from datetime import datetime, timezone
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.access import User
from lodegraph.sinks.manifests import children

FIELDS = "ts string, user string, role string, action string"


def record(user: User, action: str, ts: str | None = None, **details: Any) -> dict[str, str | None]:
    now = ts or datetime.now(timezone.utc).isoformat(timespec="seconds")
    return {"ts": now, "user": user.name, "role": user.role, "action": action,
            **{k: None if v is None else str(v) for k, v in details.items()}}


def lines(actions: DataFrame) -> DataFrame:
    """JSON text of each row; null details are left out."""
    return actions.select(F.to_json(F.struct(*actions.columns)).alias("value"))


def _folder(path: str, stamp: str, batch: str) -> str:
    """Where a batch lies: by day, and within it in the order of its last time stamp."""
    return f"{path}/day={stamp[:10]}/b={re.sub('[^0-9]', '', stamp)}-{batch}"


def append(spark: SparkSession, path: str, records: list[dict[str, str | None]]) -> None:
    """Writes the records as one batch, which is one file."""
    if not records:
        return
    columns = list(dict.fromkeys(c for r in records for c in r))
    rows = spark.createDataFrame([[r.get(c) for c in columns] for r in records], ", ".join(f"`{c}` string" for c in columns))
    stamp = max(r["ts"] for r in records)
    lines(rows).coalesce(1).write.text(_folder(path, stamp, f"{time.time_ns():020d}"))


def append_batch(actions: DataFrame, path: str, batch: str) -> None:
    """Writes the actions (with `ts`) as the batch of that name; the same batch again replaces itself."""
    stamp = actions.agg(F.max("ts")).first()[0]
    if stamp is not None:
        lines(actions.orderBy("ts").coalesce(1)).write.mode("overwrite").text(_folder(path, stamp, batch))


class Log:
    """Gathers actions and writes them in batches, at the latest on leaving the `with` block."""

    def __init__(self, spark: SparkSession, path: str, size: int = 500):
        self.spark, self.path, self.size, self.held = spark, path, size, []

    def add(self, record: dict[str, str | None]) -> None:
        self.held.append(record)
        if len(self.held) >= self.size:
            self.flush()

    def flush(self) -> None:
        held, self.held = self.held, []
        append(self.spark, self.path, held)

    def __enter__(self) -> Log:
        return self

    def __exit__(self, *_) -> None:
        self.flush()


def newest(spark: SparkSession, path: str) -> Iterator[str]:
    """The complete batches, the last one first; a day is listed only when it is reached."""
    for day in sorted((c for c in children(spark, path) if c.startswith("day=")), reverse=True):
        for batch in sorted((c for c in children(spark, f"{path}/{day}") if c.startswith("b=")), reverse=True):
            if "_SUCCESS" in children(spark, f"{path}/{day}/{batch}"):
                yield f"{path}/{day}/{batch}"


def tail(spark: SparkSession, path: str, limit: int = 200, schema: str = FIELDS, at_once: int = 8) -> DataFrame:
    """The last `limit` lines, newest first; unreadable ones among them are skipped.

    Batches are taken newest first until they hold enough lines, so what is
    read depends on the limit, not on the log: `limit` files at most.
    """
    batches, taken, found = newest(spark, path), [], 0
    while found < limit and (more := list(islice(batches, at_once))):
        taken += more
        found += spark.read.text(more).where("value <> ''").count()
        at_once *= 2
    if not taken:
        return spark.createDataFrame([], f"{schema}, record string")
    lines_of = spark.read.text(taken).where("value <> ''").select(
        "value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    order = [F.col("file").desc(), F.col("at").desc()]
    last = lines_of.orderBy(*order).limit(limit)
    parsed = last.withColumn("r", F.from_json("value", schema)).where(F.try_parse_json("value").isNotNull())
    return parsed.orderBy(*order).select("r.*", F.col("value").alias("record"))


def view(spark: SparkSession, path: str, user: User, limit: int = 200) -> DataFrame:
    user.require("can_view_audit")
    return tail(spark, path, limit)
