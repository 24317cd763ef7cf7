"""Even sample of n chunks along each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.segmented import running_rank


def stride_positions(size: Column, n: int) -> Column:
    """0-based positions of n rows spread evenly over `size` rows, both ends
    included; every position when there are no more than n."""
    if n < 2:
        raise ValueError("an even sample needs n >= 2")
    step = (size - 1) / F.lit(float(n - 1))
    spread = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * step).cast("long"))
    return F.when(size <= n, F.sequence(F.lit(0).cast("long"), (size - 1).cast("long"))).otherwise(spread)


def stride_sample(chunks: DataFrame, n: int, segment: Column, key: str = "doc_id", order: str = "seq") -> DataFrame:
    """Up to n rows per document. `segment` cuts long documents for the ranking."""
    ranked = running_rank(chunks, [key], [order], segment, "_rank")
    sizes = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    places = F.array_distinct(F.transform(stride_positions(F.col("_size"), n), lambda i: i + 1))
    wanted = sizes.select(key, F.explode(places).alias("_rank"))
    return ranked.join(wanted, [key, "_rank"]).drop("_rank")
