"""The graph as a set of tables.

One DataFrame per node label and one per edge type. Relationships that every
child row has exactly once (chunk to document, measurement to document and
property) are columns of the child table; they are offered as edges, too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, MutableMapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: the labels and what they mean ------------------------------
ENTITY_LABELS = ("Material", "Process", "Equipment", "Facility")
CANONICAL_LABELS = ("Material", "Process", "Equipment")
REVIEWABLE_LABELS = ("Material", "Process", "Equipment", "Facility", "Conclusion", "Person", "Property", "TopicTag")
CARD_LABELS = ("Material", "Process", "Equipment", "Facility", "TopicTag", "Person")
# -----------------------------------------------------------------------------


class UnknownLabel(ValueError):
    """A label outside the list an operation allows."""


def has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def column_or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if has(df, name) else F.lit(None).cast(kind)


def first_present(df: DataFrame, names: Sequence[str], empty_is_missing: bool = False) -> Column:
    """coalesce over those of the named columns a table really has."""
    found = [F.col(n).cast("string") for n in names if has(df, n)]
    if empty_is_missing:
        found = [F.nullif(c, F.lit("")) for c in found]
    return F.coalesce(*found, F.lit(None).cast("string"))


def is_verified(flag: Column | str = "needs_review") -> Column:
    """Absent counts as verified."""
    flag = F.col(flag) if isinstance(flag, str) else flag
    return ~F.coalesce(flag, F.lit(False))


def key_is(df: DataFrame, key: str) -> Column:
    """Lookup by id or by name; either may be absent from a table."""
    tests = [F.col(n).cast("string") == F.lit(key) for n in ("id", "name") if has(df, n)]
    return reduce(lambda a, b: a | b, tests)


class Frames(MutableMapping):
    """Named tables, each either a DataFrame or a function that builds it.

    A table is only planned when something reads it.
    """

    def __init__(self, tables: Mapping[str, DataFrame | Callable[[], DataFrame]] | None = None):
        self._tables = dict(tables or {})

    def __getitem__(self, name: str) -> DataFrame:
        found = self._tables[name]
        if not isinstance(found, DataFrame):
            found = self._tables[name] = found()
        return found

    def __setitem__(self, name: str, table: DataFrame | Callable[[], DataFrame]) -> None:
        self._tables[name] = table

    def __delitem__(self, name: str) -> None:
        del self._tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)

    def with_tables(self, **changed: DataFrame) -> Frames:
        return Frames({**self._tables, **changed})


@dataclass
class Graph:
    nodes: Frames = field(default_factory=Frames)
    edges: Frames = field(default_factory=Frames)
    # the chunks' vectors where they are a table of their own: (id, doc_id, embedding)
    vectors: Callable[[], DataFrame] | None = None

    def __post_init__(self) -> None:
        self.nodes = self.nodes if isinstance(self.nodes, Frames) else Frames(self.nodes)
        self.edges = self.edges if isinstance(self.edges, Frames) else Frames(self.edges)

    def node(self, label: str, allowed: Sequence[str] | None = None) -> DataFrame:
        if label not in self.nodes or (allowed is not None and label not in allowed):
            raise UnknownLabel(label)
        return self.nodes[label]

    def edge(self, kind: str) -> DataFrame:
        return self.edges[kind]

    def mentions(self, *labels: str) -> DataFrame:
        df = self.edges["MENTIONS"]
        return df.where(F.col("dst_label").isin(*labels)) if labels else df

    def chunk_vectors(self) -> DataFrame:
        """(id, doc_id, embedding) of the chunks that have a vector."""
        found = self.vectors() if self.vectors is not None else self.nodes["Chunk"]
        return found.select("id", "doc_id", "embedding").where("embedding is not null")

    def all_nodes(self, labels: Sequence[str] | None = None) -> DataFrame:
        """Every node with the columns cross-label reads need."""
        frames = []
        for label in self.nodes:
            if labels is not None and label not in labels:
                continue
            df = self.nodes[label]
            frames.append(df.select(
                F.lit(label).alias("label"),
                first_present(df, ("id", "name")).alias("key"),
                first_present(df, ("name", "grade", "id")).alias("name"),
                first_present(df, ("name", "grade", "text", "id")).alias("title_or_text"),
                first_present(df, ("title", "name", "grade", "text", "id"), True).alias("shown"),
                column_or_null(df, "confidence", "double").alias("confidence"),
                column_or_null(df, "needs_review", "boolean").alias("needs_review"),
                column_or_null(df, "reviewed_at").alias("reviewed_at"),
                column_or_null(df, "created_at").alias("created_at"),
            ))
        return reduce(DataFrame.unionByName, frames)

    def all_edges(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [
            df.select(F.lit(kind).alias("type"), F.col("src_id").cast("string"), F.col("dst_id").cast("string"))
            for kind, df in self.edges.items()
        ])

    def entities(self, labels: Sequence[str] = ENTITY_LABELS) -> DataFrame:
        """Named entities: (label, key, name, needs_review)."""
        return self.all_nodes([l for l in labels if l in self.nodes]).select("label", "key", "name", "needs_review")

    def dictionary(self) -> DataFrame:
        """Verified canonical entities with every written variant as an array."""
        frames = []
        for label in CANONICAL_LABELS:
            if label not in self.nodes:
                continue
            df = self.nodes[label]
            synonyms = F.coalesce(F.col("synonyms"), F.array().cast("array<string>")) if has(df, "synonyms") \
                else F.array().cast("array<string>")
            rows = df.where(is_verified()) if has(df, "needs_review") else df
            frames.append(rows.select(
                F.lit(label).alias("label"),
                first_present(df, ("id", "name")).alias("key"),
                first_present(df, ("name", "grade")).alias("name"),
                F.array_compact(F.concat(
                    F.array(first_present(df, ("name", "grade")), column_or_null(df, "name_en")), synonyms
                )).alias("variants"),
            ))
        return reduce(DataFrame.unionByName, frames)
