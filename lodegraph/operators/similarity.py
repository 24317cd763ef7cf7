"""Nearest vectors by cosine similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.vectors import cosine_to
from lodegraph.operators.topn import top_rows


def nearest(vectors: DataFrame, query: Sequence[float], k: int,
            id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(chunk_id, score, rank) of the k nearest; exact. Vectors without a direction are no candidates.

    A scan of the vector column alone. Every task keeps its k best, so the
    driver merges k rows per task whatever the table's size.
    """
    scored = vectors.where(F.col(vector_col).isNotNull()).select(
        F.col(id_col).alias("chunk_id"), cosine_to(query)(vector_col).alias("score")
    )
    return top_rows(scored.where(F.col("score").isNotNull()), [F.round("score", 9).desc(), F.col("chunk_id").asc()], k)
