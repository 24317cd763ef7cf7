"""Incremental forms of the loads, as Structured Streaming queries.

A query that dies repeats its last batch. Every batch below is therefore
written so that repeating it changes nothing: upserts replace by key, unchanged
conclusions are left alone, and mention counts are absolute values from the
streaming state, kept apart from those of the batch loads. How many files make
a batch changes no result: rows of one key are taken in the order they arrived.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodegraph.extraction.pipeline import embed
from lodegraph.functions.vectors import Encoder
from lodegraph.operators.versioning import apply_changes
from lodegraph.session import cut_lineage
from lodegraph.sinks import audit
from lodegraph.sinks.store import Store, conform, digest_of


def _run(stream: DataFrame, checkpoint: str, mode: str, each) -> StreamingQuery:
    """Works off what has arrived, then stops; a later start continues there."""
    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(each).start()
    )


def arriving(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files as they land in a folder; `arrived` orders their rows."""
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    place = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index")
    return files.withColumn(ARRIVED, place)


ARRIVED = "arrived"


def chunk_upserts(store: Store, chunks: DataFrame, checkpoint: str) -> StreamingQuery:
    """New and changed chunks, the last arrival of each; a changed text loses its embedding."""

    def each(batch: DataFrame, _: int) -> None:
        row = F.struct(*[c for c in batch.columns if c not in ("id", ARRIVED)])
        store.merge_chunks(batch.groupBy("id").agg(F.max_by(row, ARRIVED).alias("r")).select("id", "r.*"))

    return _run(chunks, checkpoint, "append", each)


def embeddings(store: Store, chunks: DataFrame, checkpoint: str, make_encoder: Callable[[], Encoder], batch: int = 200) -> StreamingQuery:
    """Vectors of chunks as they arrive and are stored.

    A vector is kept by chunk and text digest: what has one is not encoded
    again, whether a batch is repeated or a second stream sees the same chunk.
    Texts that are no longer the stored ones are passed over.
    """

    def each(arrived: DataFrame, _: int) -> None:
        rows = arrived.select("id", digest_of().alias("digest")).distinct()
        embed(store, store.table("Chunk").lookup(rows).join(rows, ["id", "digest"], "left_semi"), make_encoder, batch)

    return _run(chunks, checkpoint, "append", each)


def versioned_conclusions(store: Store, conclusions: DataFrame, checkpoint: str) -> StreamingQuery:
    """Conclusions with archive. The archive is written first and by key, so a
    repeated batch finds its changes already applied or applies them once."""

    def each(batch: DataFrame, _: int) -> None:
        order = F.struct("now", F.col(ARRIVED)["file_modification_time"].cast("string"), F.col(ARRIVED)["file_path"], F.col(ARRIVED)["row_index"])
        # only the buckets of the batch's conclusions are read and written
        batch = cut_lineage(batch.withColumn("_order", order))
        stored = store.table("Conclusion").lookup(batch)
        store.merge_nodes("ConclusionVersion", apply_changes(stored, batch, F.col("_order"))[1])
        store.table("Conclusion").merge(batch, lambda old, new: conform(apply_changes(old, new, F.col("_order"))[0], "Conclusion"))

    return _run(conclusions, checkpoint, "append", each)


def mention_counts(store: Store, mentions: DataFrame, checkpoint: str) -> StreamingQuery:
    """Running counts per edge, held in the streaming state.

    They go to a table of their own; Store.read("MENTIONS") adds them to the
    counts of the batch loads.
    """
    props = F.struct("source", "unit", "confidence", "extracted_at", "model")
    counted = mentions.groupBy("src_id", "dst_label", "dst_id").agg(
        F.count(F.lit(1)).alias("count"), F.max_by(props, F.struct("extracted_at", "source")).alias("p"))

    def each(batch: DataFrame, _: int) -> None:
        store.merge_edges("MENTIONS_STREAMED", batch.select("src_id", "dst_label", "dst_id", "count", "p.*"))

    return _run(counted, checkpoint, "update", each)


def audit_log(actions: DataFrame, path: str, checkpoint: str, name: str = "stream") -> StreamingQuery:
    """Actions as they arrive; a repeated batch replaces itself."""
    return _run(actions.drop(ARRIVED), checkpoint, "append", lambda batch, number: audit.append_batch(batch, path, f"{name}-{number:010d}"))
