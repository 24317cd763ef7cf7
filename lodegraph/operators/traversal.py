"""Reads along MENTIONS edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.topn import ordered_collect, top_per_group, top_rows
from lodegraph.session import TASK_ROWS, dealt, written

# --- fixed values -----------------------------------------------------------
DOCUMENT_ENTITIES = 12
# -----------------------------------------------------------------------------


def covering_documents(mentions: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Documents mentioning several of the asked entities, best covered first.

    (doc_id, matched, weight, sources, doc_rank). At least two entities have
    to be there when two or more are asked for.
    """
    need = 2 if len(keys) >= 2 else 1
    covered = (
        mentions.where(F.col("dst_id").isin(list(keys)))
        .groupBy(F.col("src_id").alias("doc_id"))
        .agg(
            # both sets are at most as long as the list of asked keys
            F.size(F.collect_set("dst_id")).cast("long").alias("matched"),
            F.sum("count").alias("weight"),
            F.collect_set("source").alias("sources"),
        )
        .where(F.col("matched") >= need)
    )
    return top_rows(covered, [F.col("matched").desc(), F.col("weight").desc(), F.col("doc_id").asc()], limit, "doc_rank")


def graph_candidates(mentions: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """(chunk_id, rank): source chunks of the `limit` best covering documents' mentions."""
    listed = covering_documents(mentions, keys, limit).select(
        "doc_rank", F.explode(F.sort_array("sources")).alias("chunk_id")
    ).where(F.coalesce(F.col("chunk_id") != "", F.lit(False)))
    first = listed.groupBy("chunk_id").agg(F.min("doc_rank").alias("doc_rank"))
    return top_rows(first, [F.col("doc_rank").asc(), F.col("chunk_id").asc()], limit).select("chunk_id", "rank")


def document_entities(mentions: DataFrame, entities: DataFrame, n: int = DOCUMENT_ENTITIES) -> DataFrame:
    """(doc_id, label, key, name, mentions, rank): top entities of each document.

    There is one edge per document and entity, so its count is the total.
    """
    counted = mentions.select(F.col("src_id").alias("doc_id"), F.col("dst_label").alias("label"),
                              F.col("dst_id").alias("key"), F.col("count").alias("mentions"))
    best = top_per_group(counted, ["doc_id"], [F.col("mentions").desc(), F.col("label").asc(), F.col("key").asc()], n)
    # names are joined after the cut: at most n rows per document need one
    return best.join(entities.select("label", "key", "name"), ["label", "key"])


def entities_array(per_document: DataFrame) -> DataFrame:
    """(doc_id, entities) from `document_entities`."""
    item = F.struct("label", "name", "mentions")
    return per_document.groupBy("doc_id").agg(ordered_collect([F.col("rank")], item).alias("entities"))


def mentioned(mentions: DataFrame, label: str, keys: DataFrame, name: str) -> DataFrame:
    """(doc_id, `name`): the mentions of a label that are among `keys` (key)."""
    return (
        mentions.where(F.col("dst_label") == label)
        .join(keys.select(F.col("key").alias("dst_id")), "dst_id", "left_semi")
        .select(F.col("src_id").alias("doc_id"), F.col("dst_id").alias(name))
    )


def comention_counts(mentions: DataFrame, left: DataFrame, right: DataFrame,
                     left_label: str, right_label: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """(left_key, right_key, docs): documents mentioning both, by pair.

    Edges are first cut to the wanted entities and written, so that they are
    counted: beyond what the shuffle's parts hold in `task_rows` each they are
    dealt to more parts. A document adds one to a pair, so pairs are counted
    before they are shuffled; a document with very many edges is split by the
    skew join while edges are few enough not to be dealt.
    """
    of_left = written(mentioned(mentions, left_label, left, "left_key"))
    of_right = written(mentioned(mentions, right_label, right, "right_key"))
    rows = of_left.count() + of_right.count()
    pairs = dealt(of_left, rows, "doc_id", task_rows=task_rows).join(dealt(of_right, rows, "doc_id", task_rows=task_rows), "doc_id")
    return pairs.groupBy("left_key", "right_key").agg(F.count(F.lit(1)).alias("docs"))


def neighbours(chunks: DataFrame, focus: DataFrame, width: int = 2) -> DataFrame:
    """(focus_id, doc_id, seq, …): the chunks up to `width` before and after.

    Each focus asks for its 2*width+1 positions by equality, which stays
    linear in a long document where a band condition would be quadratic.
    """
    asked = focus.select(
        F.col("id").alias("focus_id"), "doc_id",
        F.explode(F.sequence(F.col("seq") - width, F.col("seq") + width)).alias("seq"),
    )
    return asked.join(chunks, ["doc_id", "seq"])
