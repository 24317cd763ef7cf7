"""What several of the corpus operators share."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.session import checkpoint_dir


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def texts(docs: DataFrame, *more: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns an operator reads, under fixed names; a null text is the empty text.

    Further columns of `docs` are left behind here, so their names cannot clash.
    """
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *more
    )


def rebatched(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Splits Arrow batches so that none but single rows exceeds `limit` bytes of `column`."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        begin = held = 0
        for row, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(begin, row - begin)
                begin, held = row, 0
            held += int(size)
        if begin < batch.num_rows:
            yield batch.slice(begin)


def once(key: tuple, make: Callable):
    """What `make` returns, made once for all tasks of a Python worker process.

    Functions travel by value, so a module's own globals do not outlive a task.
    Only the last key is held: a task of another kind frees what it does not use.
    """
    made = sys.__dict__.setdefault("_made_once", {})
    if key not in made:
        made.clear()
        made[key] = make()
    return made[key]


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table of the shared checkpoint folder, read back.

    Unlike a checkpoint it carries no constraints of the plan that made it,
    which would multiply from round to round of an iteration.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_left(docs: DataFrame, digest: Column, gone: DataFrame, again: DataFrame) -> DataFrame:
    """The rows of `docs` that (doc_id, digest) in `gone` do not name, and one each of those that `again` names.

    An id alone names no row: texts may share one, and rows may have none.
    Only what stands in `again` is grouped; copies fold within each task.
    """
    rows, keys = docs.withColumn("__digest", digest), ("doc_id", "__digest")
    names = lambda df: df.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__named"))
    met = rows["doc_id"].eqNullSafe(F.col("__id")) & (rows["__digest"] == F.col("__named"))
    left = rows.join(names(gone), met, "left_anti")
    if not again.isEmpty():
        single = left.join(names(again), met, "left_anti")
        left = single.unionByName(left.join(names(again), met, "left_semi").dropDuplicates(keys))
    return left.drop("__digest")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected links (a, b): rows (id, component_id).

    Contraction under a random order of the ids (their hash): in each round
    every node takes the least of itself and its neighbours, then that node's
    own choice, and the links are redrawn between the chosen nodes. A star
    is done in two rounds and a chain shrinks about fourfold a round, whatever
    the order of its ids. Hubs are handled by map-side `min`, and both sides
    of every join are stored tables, so that a hub's rows can be split.
    component_id is the smallest id of the component; nodes without links do
    not appear. Nulls and self-links are ignored.
    """
    edges = stored(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a is not null and b is not null and a <> b").distinct()
    )
    steps = []
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), c.alias("id"))
    for _ in range(rounds):
        if edges.isEmpty():
            break
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        least = stored(
            both.groupBy(F.col("a").alias("id"))
            .agg(F.min(order(F.col("b"))).alias("best"))
            .select("id", F.least("best", order(F.col("id")))["id"].alias("to"))
        )
        then = least.select(F.col("id").alias("to"), F.col("to").alias("then"))
        chosen = stored(least.join(then, "to").select("id", F.col("then").alias("to")))
        steps.append(chosen)
        left = chosen.select(F.col("id").alias("a"), F.col("to").alias("x"))
        right = chosen.select(F.col("id").alias("b"), F.col("to").alias("y"))
        edges = stored(
            edges.join(left, "a").join(right, "b")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .where("a <> b").distinct()
        )
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    if not steps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    root = steps[0]
    for chosen in steps[1:]:
        moved = chosen.select(F.col("id").alias("to"), F.col("to").alias("next"))
        root = root.join(moved, "to", "left").select("id", F.coalesce("next", "to").alias("to"))
    root = stored(root)
    smallest = stored(root.groupBy("to").agg(F.min("id").alias("component_id")))
    return stored(root.join(smallest, "to").select("id", "component_id"))
