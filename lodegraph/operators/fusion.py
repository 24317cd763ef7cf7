"""Reciprocal-rank fusion and the diversity pass over its result."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
RRF_K = 60
PER_DOCUMENT = 2
# channel order decides ties
CHANNELS = ("vector", "fulltext", "graph", "measure")
# -----------------------------------------------------------------------------


def fetch_size(k: int) -> int:
    """Candidates asked of each channel for k results."""
    return max(k * 5, 40)


def channel(df: DataFrame, name: str) -> DataFrame:
    """(chunk_id, rank) of one channel, labelled; ranks start at 1."""
    return df.select(
        "chunk_id", F.col("rank").cast("int").alias("rank"),
        F.lit(CHANNELS.index(name)).alias("channel"),
    )


def fuse(channels: Sequence[DataFrame], rrf_k: int = RRF_K) -> DataFrame:
    """(chunk_id, rrf_score, via_graph, via_measure, position).

    Each channel holds at most its fetch size, a request parameter, so the
    ordering window below sees a few hundred rows. Equal scores keep the order
    of first appearance: earlier channel, then earlier rank.
    """
    pooled = reduce(DataFrame.unionByName, channels)
    scored = pooled.groupBy("chunk_id").agg(
        F.sum(F.lit(1.0) / (F.lit(rrf_k) + F.col("rank"))).alias("rrf_score"),
        F.min(F.struct("channel", "rank")).alias("first_seen"),
        F.bool_or(F.col("channel") == CHANNELS.index("graph")).alias("via_graph"),
        F.bool_or(F.col("channel") == CHANNELS.index("measure")).alias("via_measure"),
    )
    order = Window.orderBy(F.col("rrf_score").desc(), "first_seen", "chunk_id")
    return scored.withColumn("position", F.row_number().over(order)).drop("first_seen")


def diversify(candidates: DataFrame, k: int, per_document: int = PER_DOCUMENT) -> DataFrame:
    """The first k candidates, skipping repeated texts and crowded documents.

    A candidate dropped for its document does not reserve its text, so a copy
    in another document may still appear; that makes the rule sequential. It
    is a fold over the fused candidates, whose number the request bounds.
    Needs (position, chunk_id, doc_id, signature); keeps every column and adds
    `place`, 1 to k.
    """
    columns = [c for c in candidates.columns if c != "position"]
    ints, texts = F.array().cast("array<int>"), F.array().cast("array<string>")
    state = F.struct(ints.alias("kept"), texts.alias("docs"), texts.alias("seen"))

    def step(s, c):
        doc = F.coalesce(c["doc_id"].cast("string"), F.lit(""))
        text = F.coalesce(c["signature"], F.lit(""))
        fresh = (text == "") | ~F.array_contains(s["seen"], text)
        room = F.size(F.filter(s["docs"], lambda d: d == doc)) < per_document
        take = (F.size(s["kept"]) < k) & fresh & room

        def grow(name, value):
            return F.when(take, F.concat(s[name], F.array(value))).otherwise(s[name]).alias(name)

        return F.struct(
            grow("kept", F.coalesce(c["position"], F.lit(0))), grow("docs", doc), grow("seen", text)
        )

    rows = candidates.agg(F.sort_array(F.collect_list(F.struct("position", *columns))).alias("rows"))
    return (
        rows.select("rows", F.aggregate("rows", state, step)["kept"].alias("kept"))
        .select("kept", F.explode(F.filter("rows", lambda r: F.array_contains(F.col("kept"), r["position"]))).alias("r"))
        .select("r.*", F.array_position("kept", F.col("r.position")).cast("int").alias("place"))
    )
