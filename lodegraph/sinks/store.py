"""The graph as keyed tables of Parquet files.

Every table lies in hash buckets under a manifest (`buckets`): a batch costs
the buckets it touches, and readers keep the state they began with.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph import model
from lodegraph.access import User, visible_graph
from lodegraph.graph import Frames, Graph, UnknownLabel
from lodegraph.operators.fulltext import index_version, search_index, update_index, write_index
from lodegraph.operators.vector_index import VectorIndex
from lodegraph.session import cut_lineage
from lodegraph.sinks import manifests, upsert
from lodegraph.sinks.buckets import ROWS_A_BUCKET, Buckets


# large tables read by key: row groups without the key are skipped
KEY_FILTERS = {"Chunk": ("id", "doc_id"), "MENTIONS": ("src_id", "dst_id")}
# tables whose batches replace all rows of one value of a column
BUCKETED_BY = {"MENTIONS_EXTRACTED": ["source"]}
# never nodes of the graph: what is kept beside the chunks
BESIDE_CHUNKS = ("ChunkState", "ChunkVector")


def conform(df: DataFrame, name: str) -> DataFrame:
    """The table's columns in their declared types; missing ones are null."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in model.layout(name).fields
    ])


def digest_of(text: str = "text") -> F.Column:
    """What tells whether a text has changed since something was made of it."""
    return F.xxhash64(text)


class Store:
    def __init__(self, spark: SparkSession, root: str, rows_a_bucket: int = ROWS_A_BUCKET, keep_hours: float = manifests.KEEP_HOURS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.rows_a_bucket, self.keep_hours = rows_a_bucket, keep_hours

    def _children(self, folder: str) -> list[str]:
        return manifests.children(self.spark, folder)

    def table(self, name: str) -> Buckets:
        if name not in model.NODES and name not in model.EDGES:
            raise UnknownLabel(name)
        key = model.node_key(name) if name in model.NODES else model.edge_key(name)
        filters = {f"parquet.bloom.filter.enabled#{c}": "true" for c in KEY_FILTERS.get(name, ())}
        return Buckets(self.spark, f"{self.root}/{name}", model.layout(name), BUCKETED_BY.get(name, key),
                       self.rows_a_bucket, filters, keep_hours=self.keep_hours)

    def snapshot(self, name: str) -> int | None:
        """Number of the table's last manifest."""
        return self.table(name).version()

    def read(self, name: str) -> DataFrame:
        """The table as readers see it: mentions with what streams and extraction have counted."""
        parts = [p for p in model.MENTION_PARTS if name == "MENTIONS" and self.snapshot(p) is not None]
        return upsert.added_counts(self.stored(name), *map(self.stored, parts)) if parts else self.stored(name)

    def stored(self, name: str) -> DataFrame:
        return self.table(name).read()

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Replaces the table and returns it."""
        self.table(name).write(conform(df, name))
        return self.stored(name)

    def create(self) -> list[str]:
        """Gives every table a first, empty snapshot; existing tables stay."""
        made = [n for n in (*model.NODES, *model.EDGES) if self.snapshot(n) is None]
        for name in made:
            self.write(name, self.spark.createDataFrame([], model.layout(name)))
        return made

    def wipe(self) -> None:
        """Empties every table; layouts and older snapshots stay."""
        for name in (*model.NODES, *model.EDGES):
            if self.snapshot(name) is not None:
                self.write(name, self.spark.createDataFrame([], model.layout(name)))

    def graph(self, user: User | None = None) -> Graph:
        """All tables; with a user only what the user's role may read."""
        edges = {kind: (lambda kind=kind: self.read(kind)) for kind in model.EDGES if kind not in model.MENTION_PARTS}
        for kind, (label, src, dst) in model.DERIVED.items():
            edges[kind] = lambda label=label, src=src, dst=dst: self.read(label).select(
                F.col(src).alias("src_id"), F.col(dst).cast("string").alias("dst_id"))
        graph = Graph(
            nodes=Frames({label: (lambda label=label: self.read(label)) for label in model.NODES if label not in BESIDE_CHUNKS}),
            edges=Frames(edges), vectors=lambda: self.stored("ChunkVector"),
        )
        return graph if user is None else visible_graph(graph, user)

    @property
    def index(self) -> str:
        return f"{self.root}/_index"

    def index_chunks(self) -> None:
        """Builds the text index anew from all chunks."""
        write_index(self.read("Chunk"), self.index)

    def fulltext(self, query: str) -> Callable[[int, DataFrame | None], DataFrame] | None:
        """The stored index as a search channel, None before the first `index_chunks`."""
        if index_version(self.spark, self.index) is None:
            return None
        return lambda n, within: search_index(self.spark, self.index, query, n, within)

    @property
    def vector_index(self) -> VectorIndex:
        return VectorIndex(self.spark, f"{self.root}/_vectors")

    def index_vectors(self) -> None:
        """Builds the vector index anew from all chunks' vectors."""
        self.vector_index.build(self.stored("ChunkVector"))

    def vectors(self, query: Sequence[float]) -> Callable[[int, DataFrame | None], DataFrame] | None:
        """The stored vector index as a search channel, None before the first `index_vectors`."""
        if self.vector_index.version() is None:
            return None
        return lambda n, within: self.vector_index.search(query, n, within)

    def _merge(self, name: str, rows: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        self.table(name).merge(rows, lambda old, batch: conform(merged(old, batch), name))
        return self.stored(name)

    def merge_nodes(self, label: str, rows: DataFrame, order: str | None = None) -> DataFrame:
        keys = model.node_key(label)
        return self._merge(label, rows, lambda old, new: upsert.overwrite(old, new, keys, order))

    def create_nodes(self, label: str, rows: DataFrame, fill: Iterable[str] = (), order: str | None = None) -> DataFrame:
        keys = model.node_key(label)
        return self._merge(label, rows, lambda old, new: upsert.create_only(old, new, keys, list(fill), order))

    def merge_edges(self, kind: str, rows: DataFrame, order: str | None = None) -> DataFrame:
        """Writes edges; one whose ends are not both there is left out."""
        keys = model.edge_key(kind)
        for column, label in zip(("src_id", "dst_id"), model.ENDS.get(kind, ())):
            if label is not None:
                known = self.stored(label).select(F.col(model.node_key(label)[0]).cast("string").alias(column))
                rows = rows.join(known, column, "left_semi")
        return self._merge(kind, rows, lambda old, new: upsert.overwrite(old, new, keys, order))

    def count_mentions(self, rows: DataFrame, order: str) -> DataFrame:
        return self._merge("MENTIONS", rows, lambda old, new: upsert.counted_edges(old, new, order=order))

    def replace_mentions(self, rows: DataFrame, chunks: DataFrame, order: str) -> DataFrame:
        """Mentions found in `chunks` (id), instead of those found there before.

        One row for each edge and chunk, so writing them again changes nothing.
        """
        name = "MENTIONS_EXTRACTED"
        keys = [*model.edge_key("MENTIONS"), "source"]
        columns = [f.name for f in model.layout(name).fields]
        props = F.struct(*[F.col(c) for c in columns if c in rows.columns and c not in (*keys, "count")])
        known = self.stored("Document").select(F.col("id").alias("src_id"))
        found = rows.join(known, "src_id", "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.max_by(props, order).alias("p"))
        batch = chunks.select(F.col("id").alias("source"), F.lit(True).alias("_asked")).unionByName(
            conform(found.select(*keys, "count", "p.*"), name), allowMissingColumns=True)

        def merged(old: DataFrame, new: DataFrame) -> DataFrame:
            asked = new.where("_asked").select("source").distinct()
            return old.join(asked, "source", "left_anti").unionByName(new.where("_asked is null").select(*old.columns))

        return self._merge(name, batch, merged)

    def merge_chunks(self, rows: DataFrame) -> DataFrame:
        """Writes the chunks; vectors of texts that have changed go, and the text index, if there is one, follows.

        The vectors go first: a run that dies in between has lost some, which
        are made again, and keeps none of another text.
        """
        given = [f.name for f in model.layout("Chunk").fields if f.name in (*rows.columns, "digest")]
        rows = cut_lineage(conform(rows.withColumn("digest", digest_of()), "Chunk").select(*given))
        vectors = self.table("ChunkVector")
        if vectors.rows():
            new = rows.select("id", F.col("digest").alias("_digest"))
            stale = vectors.lookup(new).join(new, "id").where("digest <> _digest").select("id")
            stale = cut_lineage(stale)
            vectors.delete(stale)
            if self.vector_index.version() is not None:
                self.vector_index.delete(stale)
        merged = self._merge("Chunk", rows, lambda old, new: upsert.overwrite(old, new, ["id"]))
        if index_version(self.spark, self.index) is not None:
            update_index(rows, self.index)
        return merged

    def unembedded(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """Chunks whose text has no vector yet, of all or of some of the chunk table's buckets."""
        chunks = self.table("Chunk").read(buckets)
        return chunks.join(self.stored("ChunkVector").select("id", "digest"), ["id", "digest"], "left_anti")

    def merge_vectors(self, rows: DataFrame) -> None:
        """Writes (id, doc_id, digest, embedding); writing them again changes nothing. The vector index follows."""
        if self.vector_index.version() is not None:
            self.vector_index.update(rows)
        self._merge("ChunkVector", rows, lambda old, new: upsert.overwrite(old, new, ["id"]))
