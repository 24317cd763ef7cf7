"""A stored vector index: lists of vectors around centroids, read by the lists a query needs.

Vectors lie by list in segments (`sinks.segments`), each list in few files of
its own, so the lists of a query are the only files it opens. Every list knows
the largest angle between its centroid and a member. A search looks into the
nearest lists first; the k-th best score it finds there proves, by the
triangle inequality on angles, which other lists cannot hold a better vector,
and only the rest are read as well. `exact=False` leaves out that second step:
the number of lists looked into is then chosen at build time so that at least
RECALL of the true neighbours of a sample of stored vectors lie in them.

The centroids are fitted once on a bounded sample: SAMPLE_A_LIST vectors for
each of at most MOST_LISTS lists. All vectors are indexed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.vectors import cosine_to, unit_rows
from lodegraph.operators.topn import top_per_group, top_rows
from lodegraph.sinks import manifests
from lodegraph.sinks.segments import Segments

# lists x dimensions x 8 bytes travel to every task of a build: 100 MB at 768 dimensions
MOST_LISTS, SAMPLE_A_LIST, ROUNDS = 16_384, 64, 8
RECALL, JUDGES, JUDGED = 0.98, 128, 10
ROWS_A_BAND = 50_000
# cells of the tables of likeness a task holds at a time, 8 bytes each
CELLS = 1 << 18
# more than what a score or an angle loses in double precision
SLACK = 1e-7


def usable(vectors: DataFrame, id_col: str, vector_col: str, dims: int | None = None) -> DataFrame:
    """(id, embedding) of the vectors that have a direction (and `dims` components)."""
    v = F.col(vector_col).cast("array<double>")
    squares = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    finite = (squares > 0) & ~F.isnan(squares) & (squares < float("inf"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding")).where(F.coalesce(finite, F.lit(False)))
    return rows if dims is None else rows.where(F.size("embedding") == dims)


def _fitted(rows: DataFrame, count: int, lists: int) -> np.ndarray:
    """Centroids as unit vectors, of a sample of the rows that a hash of the id draws."""
    share = min(1.0, SAMPLE_A_LIST * lists / max(count, 1))
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    drawn = drawn.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=max(lists, 2), initMode="random", maxIter=ROUNDS, seed=1, distanceMeasure="cosine").fit(drawn)
    return unit_rows(np.array(model.clusterCenters()))


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _placed(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds list and angle: the nearest centroid's number and the angle to it."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # lists grow with the index: as many rows at a time as the table of their likeness has room for
        for batch in sliced(batches, max(1, CELLS // len(centroids))):
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            likeness = unit_rows(flat.reshape(-1, centroids.shape[1])) @ centroids.T
            best = likeness.argmax(axis=1)
            angle = np.arccos(np.clip(likeness[np.arange(len(best)), best], -1, 1))
            yield batch.append_column("list", pa.array(best, pa.int32())).append_column("angle", pa.array(angle, pa.float64()))

    return rows.select("id", "embedding").mapInArrow(run, f"{kinds}, list int, angle double")


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str, rows_a_band: int = ROWS_A_BAND):
        self.spark, self.path, self.rows_a_band = spark, path, rows_a_band
        self.segments = Segments(spark, path, ("vectors",))

    def version(self) -> int | None:
        return next(iter(manifests.numbers(self.spark, self.path)), None)

    # --- writing

    def build(self, vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding", lists: int | None = None) -> None:
        """A new index of all vectors that have a direction and as many components as most of them."""
        rows = usable(vectors, id_col, vector_col)
        sizes = rows.groupBy(F.size("embedding").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").first()
        count, dims = (sizes["n"], sizes["dims"]) if sizes else (0, 0)
        rows = rows.where(F.size("embedding") == dims)
        lists = min(lists or max(1, round(count ** 0.5)), MOST_LISTS, max(count, 1))
        centroids = _fitted(rows, count, lists) if count > 1 else np.ones((1, max(dims, 1))) / max(dims, 1) ** 0.5
        number = self.segments.following()
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>") \
            .coalesce(1).write.parquet(f"{self.path}/centroids/c={number}")
        kind = rows.schema["id"].dataType.simpleString()
        state: dict[str, Any] = {
            "schema": f"id {kind}, embedding {rows.schema['embedding'].dataType.simpleString()}, list int, angle double",
            "dead_schema": f"id {kind}", "segments": {}, "dead": {}, "centroids": number, "lists": len(centroids), "dims": dims,
        }
        state["segments"][str(number)] = self._segment(_placed(rows, centroids), number, len(centroids))
        state |= self._calibrated(state, centroids)
        self.segments.publish(state)

    def _segment(self, placed: DataFrame, number: int, lists: int) -> dict[str, Any]:
        """Writes a segment by bands of lists; its size and bands, the lists' radii beside it."""
        bands = min(lists, max(1, placed.count() // self.rows_a_band))
        width = -(-lists // bands)
        target = f"{self.path}/rows/s={number}"
        (placed.withColumn("band", F.expr(f"list div {width}").cast("int")).repartitionByRange("band", "list", "id")
         .sortWithinPartitions("band", "list", "id").write.partitionBy("band").parquet(target))
        stored = self.spark.read.schema("list int, angle double, band int").parquet(target)
        stored.groupBy("list", "band").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")) \
            .write.parquet(f"{self.path}/lists/s={number}")
        found = self.spark.read.parquet(f"{self.path}/lists/s={number}").groupBy("band").agg(F.sum("n").alias("n")).collect()
        rows = sum(r["n"] for r in found)
        return {"rows": rows, "totals": [rows], "width": width, "bands": sorted(r["band"] for r in found)}

    def _centroids(self, state: dict[str, Any]) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/centroids/c={state['centroids']}").orderBy("list").collect()
        return np.array([r["centroid"] for r in rows])

    def update(self, changed: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> None:
        """Adds vectors, instead of those of the same ids; the batch is one more segment.

        An id whose vector has no direction or another number of components
        leaves the index.
        """
        self._change(changed.select(F.col(id_col).alias("id")).distinct(), usable(changed, id_col, vector_col))

    def delete(self, ids: DataFrame) -> None:
        self._change(ids.toDF("id").distinct(), None)

    def _change(self, ids: DataFrame, rows: DataFrame | None) -> None:
        state, number = self.segments.state(), self.segments.following()
        entries = self.segments.alive(state, self.segments.read(state).select("id", "s"), "id")
        self.segments.bury(state, number, entries, ids, "id", [])
        if rows is not None:
            placed = _placed(rows.where(F.size("embedding") == state["dims"]), self._centroids(state))
            state["segments"][str(number)] = self._segment(placed, number, state["lists"])
        self.segments.merge_due(state, lambda live, n: self._segment(live.select("id", "embedding", "list", "angle"), n, state["lists"]), "id")
        self.segments.publish(state)

    # --- reading

    def _calibrated(self, state: dict[str, Any], centroids: np.ndarray) -> dict[str, float]:
        """probes: how many lists hold RECALL of the JUDGED nearest others of a sample of vectors; recall: the part they do hold."""
        rows = self._rows(state, range(len(centroids))).select("id", "embedding", "list")
        judges = rows.orderBy(F.xxhash64("id"), "id").limit(JUDGES).collect()
        if len(judges) < 2:
            return {"probes": 1, "recall": 1.0}
        asked, ids = unit_rows(np.array([r["embedding"] for r in judges], float)), [r["id"] for r in judges]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:  # the best of each batch for every judge
                flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                likeness = asked @ unit_rows(flat.reshape(-1, asked.shape[1])).T
                place = {x: i for i, x in enumerate(batch.column("id").to_pylist())}
                for j, own in enumerate(ids):
                    if own in place:
                        likeness[j, place[own]] = -2.0  # itself
                best = np.argsort(-likeness, axis=1, kind="stable")[:, :JUDGED]
                lists = batch.column("list").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.arange(len(ids)), best.shape[1]), pa.int32()), pa.array(lists[best].ravel(), pa.int32()),
                     pa.array(np.take_along_axis(likeness, best, axis=1).ravel())], ["judge", "list", "score"])

        found = top_per_group(rows.mapInArrow(run, "judge int, list int, score double").where("score > -2"),
                              ["judge"], [F.col("score").desc(), F.col("list").asc()], JUDGED).collect()
        order = np.argsort(-(asked @ centroids.T), axis=1, kind="stable")
        places = np.sort([int(np.flatnonzero(order[r["judge"]] == r["list"])[0]) + 1 for r in found])
        probes = int(places[max(0, int(np.ceil(RECALL * len(places))) - 1)])
        return {"probes": probes, "recall": round(float((places <= probes).mean()), 4)}

    def _parts(self, state: dict[str, Any], lists: Sequence[int]) -> list[str]:
        """The folders, of all segments, that may hold the lists."""
        out = []
        for n, segment in state["segments"].items():
            wanted = {i // segment["width"] for i in lists}
            out += [f"{n}/band={b}" for b in segment["bands"] if b in wanted]
        return out

    def _rows(self, state: dict[str, Any], lists: Sequence[int]) -> DataFrame:
        rows = self.segments.read(state, self._parts(state, lists))
        if len(lists) < state["lists"]:
            rows = rows.where(F.col("list").isin(list(map(int, lists))))
        return self.segments.alive(state, rows, "id")

    def _near_lists(self, state: dict[str, Any], query: Sequence[float]) -> list[tuple[int, float, float]]:
        """(list, angle to the query, radius), the nearest first; as many rows as there are lists."""
        radii = self.spark.read.parquet(*[f"{self.path}/lists/s={n}" for n in state["segments"]]).groupBy("list").agg(F.max("radius").alias("radius"))
        centroids = self.spark.read.parquet(f"{self.path}/centroids/c={state['centroids']}")
        found = centroids.join(radii, "list").select("list", cosine_to(query)("centroid").alias("likeness"), "radius").collect()
        return sorted(((r["list"], float(np.arccos(np.clip(r["likeness"], -1, 1))), r["radius"]) for r in found), key=lambda r: (r[1], r[0]))

    def search(self, query: Sequence[float], k: int, within: DataFrame | None = None, exact: bool = True) -> DataFrame:
        """(chunk_id, score, rank) of the k nearest, of those in `within` (chunk_id) if given."""
        state = self.segments.state()
        order = [F.round("score", 9).desc(), F.col("chunk_id").asc()]

        def best(lists: Sequence[int]) -> DataFrame:
            scored = self._rows(state, lists).select(F.col("id").alias("chunk_id"), cosine_to(query)("embedding").alias("score"))
            if within is not None:
                scored = scored.join(within, "chunk_id", "left_semi")
            return scored.where(F.col("score").isNotNull())

        near = self._near_lists(state, query) if len(query) == state["dims"] and np.isfinite(query).all() and any(query) else []
        probes = state["probes"]
        first = top_rows(best([n for n, *_ in near[:probes]]), order, k)
        if not exact or len(near) <= probes:
            return first
        rows = first.drop("rank").collect()  # k at most
        least = min(r["score"] for r in rows) if len(rows) == k else -2.0
        others = [n for n, angle, radius in near[probes:] if np.cos(max(0.0, angle - radius - SLACK)) >= least - SLACK]
        held = self.spark.createDataFrame(rows, first.drop("rank").schema)
        return top_rows(held.unionByName(best(others)), order, k)
