"""Numeric constraints against stored measurements."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.numeric import constraint_bounds, overlaps
from lodegraph.functions.text import contains_stems, name_stems, normalize_unit, tokens
from lodegraph.operators.topn import top_rows

def valid_constraints(constraints: Sequence[Any] | None) -> list[dict[str, Any]]:
    """Those that name a property and a number."""
    return [
        c for c in constraints or []
        if isinstance(c, dict) and (c.get("property") or "").strip() and isinstance(c.get("value"), (int, float))
    ]


def constraint_hits(measurements: DataFrame, constraints: Sequence[dict[str, Any]]) -> DataFrame:
    """(chunk_id, hits): how often a chunk's measurements meet a constraint.

    Each constraint is a row-local test, so any number of them costs one scan;
    counting is partial before the shuffle. Property names are matched per
    distinct name, not per measurement.
    Needs (property, value, value_max, unit, source).
    """
    asked = valid_constraints(constraints)
    if not asked:
        return measurements.select(F.col("source").alias("chunk_id"), F.lit(0).cast("long").alias("hits")).limit(0)
    flags = []
    # texts are compared per distinct (property, unit), numbers per measurement
    # (aggregate outputs, unlike grouping keys, keep the tests above the grouping)
    kinds = measurements.groupBy("property", "unit").agg(
        F.any_value("property").alias("_name"), normalize_unit(F.any_value("unit")).alias("_unit"))
    for i, c in enumerate(asked):
        unit = normalize_unit(F.lit(c.get("unit")))
        same_unit = (unit == "") | (F.col("_unit") == "") | (unit == F.col("_unit"))
        same_property = contains_stems(tokens("_name"), name_stems(F.lit(c["property"])))
        kinds = kinds.withColumn(f"k{i}", same_property & same_unit)
        low, high = constraint_bounds(c.get("op"), float(c["value"]), c.get("value_max"))
        flags.append((F.col(f"k{i}") & overlaps(F.col("value"), F.col("value_max"), low, high)).cast("int"))
    wanted = kinds.where(" or ".join(f"k{i}" for i in range(len(asked)))).select(
        F.col("property").alias("_p"), F.col("unit").alias("_u"), *[f"k{i}" for i in range(len(asked))])
    return (
        measurements.where(F.col("value").isNotNull() & F.coalesce(F.col("source") != "", F.lit(False)))
        .join(wanted, (F.col("property") == F.col("_p")) & F.col("unit").eqNullSafe(F.col("_u")))
        .select(F.col("source").alias("chunk_id"), reduce(lambda a, b: a + b, flags).alias("hit"))
        .where(F.col("hit") > 0)
        .groupBy("chunk_id").agg(F.sum("hit").alias("hits"))
    )


def measurement_candidates(measurements: DataFrame, constraints: Sequence[dict[str, Any]],
                           limit: int, within: DataFrame | None = None) -> DataFrame:
    """(chunk_id, hits, rank) of the chunks meeting most constraints, of those in `within` if given."""
    hits = constraint_hits(measurements, constraints)
    if within is not None:
        hits = hits.join(within, "chunk_id", "left_semi")
    return top_rows(hits, [F.col("hits").desc(), F.col("chunk_id").asc()], limit)
