"""Centroid clustering over a vector-approximation file.

Every vector is stored twice: as it is, and as a few bits per dimension that
name the cell its component lies in. For each centroid, tables of the least
and the greatest squared distance from any cell, by dimension, give an
interval for the distance of every vector. Where one centroid's interval ends
before all others begin, the short form alone decides; only the other vectors
are fetched and compared exactly.

A round needs each cluster's exact sums. They are carried from round to round:
a vector counts only when its cluster has changed. Which cluster it was in
follows from the centroids of the round before, so no assignment is stored,
and a vector that both rounds decide alike is never fetched. All sums are
integers; a task's sums travel as two or more 32-bit limbs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import stored
from lodegraph.session import cut_lineage

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
BITS = 4
# fetched rows are looked up by a broadcast of their numbers (8 bytes each) up to this many
BROADCAST_ROWS = 500_000
# components up to which sums and squares of a batch stay within 64 bits; larger ones are worked with as Python integers
SMALL = 1 << 24
LARGEST, FAR = (1 << 63) - 1, 10**308


def usable(vectors: DataFrame, dims: int, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v) of the vectors with exactly `dims` components, none null or non-finite."""
    x = F.col("v")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where((F.size("v") == dims) & finite)


def integers(flat: np.ndarray, dims: int) -> np.ndarray:
    """floor(SCALE * x) as rows: 64-bit integers, or Python integers if any is large."""
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * SCALE)
    if flat.size == 0 or np.abs(scaled).max() <= SMALL:
        return scaled.astype(np.int64).reshape(-1, dims)
    # SCALE is a power of two, so a component too large to scale is an integer
    whole = [int(s) if np.isfinite(s) else int(v) * SCALE for s, v in zip(scaled.tolist(), flat.tolist())]
    return np.array(whole, object).reshape(-1, dims)


def rows_of(column: pa.Array, dims: int) -> np.ndarray:
    return integers(column.flatten().to_numpy(zero_copy_only=False), dims)


def square_distances(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances, one column a centroid."""
    large = x.dtype == object or max(abs(c) for row in centroids for c in row) > SMALL
    kind = object if large else np.int64
    x = x.astype(kind)
    return np.stack([((x - np.array(row, kind)) ** 2).sum(axis=1) for row in centroids], axis=1)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance); of equally near ones the smaller number."""
    d = square_distances(x, centroids)
    best = np.array(d.argmin(axis=1), np.int64) if len(x) else np.zeros(0, np.int64)
    return best, d[np.arange(len(x)), best]


def tables(edges: list[list[float]], centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) squared distance of a centroid from a cell, by dimension, centroid and cell.

    `edges` are, by dimension, the cells' borders: cell j holds what lies from
    edge j to edge j + 1. Rounded outwards by more than the sums can lose.
    """
    low, high = np.array([e[:-1] for e in edges]), np.array([e[1:] for e in edges])
    # what no double can hold counts as very far; such intervals overlap and are compared exactly
    c = np.array([[float(min(max(x, -FAR), FAR)) for x in row] for row in centroids]).T[:, :, None]
    with np.errstate(over="ignore"):
        below, above = low[:, None, :] - c, c - high[:, None, :]
        least = np.maximum(np.maximum(below, above), 0.0) ** 2
        greatest = np.maximum(np.abs(below), np.abs(above)) ** 2
    return least * (1 - 1e-9), greatest * (1 + 1e-9)


def undecided(cells: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of a centroid that may be nearest, whether another may be as well) for rows of cells."""
    low, high = (np.zeros((len(cells), least.shape[1])) for _ in range(2))
    for d in range(cells.shape[1]):
        low += least[d][:, cells[:, d]].T
        high += greatest[d][:, cells[:, d]].T
    possible = low <= high.min(axis=1, keepdims=True)
    return possible.argmax(axis=1), possible.sum(axis=1) > 1


def packed(cells: np.ndarray, bits: int) -> list[bytes]:
    if bits == 4 and cells.shape[1] % 2 == 0:
        cells = cells[:, ::2] << 4 | cells[:, 1::2]
    return [row.tobytes() for row in cells.astype(np.uint8)]


def unpacked(column: pa.Array, dims: int, bits: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    if bits == 4 and dims % 2 == 0:
        flat = np.stack([flat >> 4, flat & 15], axis=1)
    return flat.reshape(-1, dims)


def limbs(value: int) -> list[int]:
    """An integer as 32-bit limbs, the last one signed; at least two, so that most values have as many."""
    out = []
    while len(out) < 1 or not -(1 << 40) < value < 1 << 40:
        out.append(value & 0xFFFFFFFF)
        value >>= 32
    return [*out, value]


def _moves(batches: Iterator[pa.RecordBatch], dims: int, before, now) -> Iterator[pa.RecordBatch]:
    """Changes of the clusters' counts and sums, folded over the task: rows (cluster, dim, limb, value); dim -1 counts."""
    sums: dict[int, list] = {}

    def add(cluster: int, sign: int, x: np.ndarray) -> None:
        held = sums.setdefault(cluster, [0] * (dims + 1))
        for d, value in enumerate([len(x), *x.sum(axis=0).tolist()]):
            held[d] += sign * int(value)

    for batch in batches:
        x = rows_of(batch.column("v"), dims)
        to, _ = nearest(x, now)
        moved = np.ones(len(x), bool)
        if before is not None:
            was, _ = nearest(x, before)
            moved = was != to
            for cluster in np.unique(was[moved]).tolist():
                add(cluster, -1, x[moved & (was == cluster)])
        for cluster in np.unique(to[moved]).tolist():
            add(cluster, 1, x[moved & (to == cluster)])
    out = [(c, d - 1, k, limb) for c, held in sums.items() for d, value in enumerate(held) for k, limb in enumerate(limbs(value))]
    columns = list(zip(*out)) if out else [[]] * 4
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["cluster", "dim", "limb", "value"])


class Clustering:
    """The approximation file of one table, and the rounds over it.

    `fetched` lists how many vectors each round had to look at in full.
    """

    def __init__(self, vectors: DataFrame, dims: int = DIMS, bits: int = BITS, vec_id: str = "vec_id", vector: str = "embedding"):
        self.dims, self.bits, self.fetched = dims, bits, []
        rows = usable(vectors, dims, vec_id, vector)
        self.edges = self._edges(rows)
        # written once and read by columns: rounds read (row, cells), and (row, v) of what they fetch
        self.table = stored(self._approximated(rows))

    def _edges(self, rows: DataFrame) -> list[list[float]]:
        """Borders of the cells by dimension: quantiles of the components, so that cells hold about equally many."""
        share = [i / (1 << self.bits) for i in range(1, 1 << self.bits)]
        part = [F.col("v")[d] for d in range(self.dims)]
        ends = rows.agg(
            F.array(*[F.min(x) for x in part]).alias("low"), F.array(*[F.max(x) for x in part]).alias("high"),
            F.array(*[F.percentile_approx(x, share, 2000) for x in part]).alias("inner"),
        ).first()
        if ends["low"][0] is None:  # no rows; any borders do
            return [[0.0] * ((1 << self.bits) + 1)] * self.dims
        with np.errstate(over="ignore"):
            return [np.floor(np.array([a, *inner, b]) * SCALE).tolist() for a, inner, b in zip(ends["low"], ends["inner"], ends["high"])]

    def _approximated(self, rows: DataFrame) -> DataFrame:
        """(row, vec_id, v, cells): the vectors with a number and their cells."""
        inner = [np.array(e[1:-1]) for e in self.edges]
        dims, bits = self.dims, self.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                with np.errstate(over="ignore"):
                    x = np.floor(batch.column("v").flatten().to_numpy(zero_copy_only=False) * SCALE).reshape(-1, dims)
                cells = np.stack([np.searchsorted(inner[d], x[:, d], "right") for d in range(dims)], axis=1)
                yield batch.append_column("cells", pa.array(packed(cells, bits), pa.binary()))

        kind = rows.schema["vec_id"].dataType.simpleString()
        numbered = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")
        return numbered.mapInArrow(run, f"row long, vec_id {kind}, v array<double>, cells binary")

    def first_centroids(self, k: int, seed: int) -> list[list[int]]:
        """The vectors whose ids have the smallest digests; of equal digests the smaller vector first."""
        digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
        chosen = self.table.where("vec_id is not null").select(digest.alias("digest"), "v").orderBy("digest", "v").limit(k).collect()
        return [integers(np.array(r["v"]), self.dims)[0].tolist() for r in chosen]

    def to_fetch(self, before: list[list[int]], now: list[list[int]]) -> DataFrame:
        """Numbers of the rows whose cluster, before or now, the cells leave open, or which have changed cluster."""
        dims, bits = self.dims, self.bits
        was, becomes = tables(self.edges, before), tables(self.edges, now)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = unpacked(batch.column("cells"), dims, bits)
                old, open_before = undecided(cells, *was)
                new, open_now = undecided(cells, *becomes)
                wanted = open_before | open_now | (old != new)
                yield pa.RecordBatch.from_arrays([batch.column("row").filter(pa.array(wanted))], ["row"])

        return self.table.select("row", "cells").mapInArrow(run, "row long")

    def move(self, before: list[list[int]] | None, now: list[list[int]]) -> dict[tuple[int, int], int]:
        """Changes of (cluster, dim) sums and, under dim -1, of counts."""
        rows, dims = self.table.select("row", "v"), self.dims
        if before is not None:
            wanted = cut_lineage(self.to_fetch(before, now))
            self.fetched.append(wanted.count())
            if self.fetched[-1] <= BROADCAST_ROWS:
                wanted = F.broadcast(wanted)
            rows = rows.join(wanted, "row", "left_semi")
        changes = (
            rows.select("v").mapInArrow(lambda b: _moves(b, dims, before, now), "cluster int, dim int, limb int, value long")
            .groupBy("cluster", "dim", "limb").agg(F.sum("value").alias("value"))
        )
        out: dict[tuple[int, int], int] = {}
        for r in changes.collect():  # at most clusters x dimensions x a few limbs
            at = (r["cluster"], r["dim"])
            out[at] = out.get(at, 0) + (r["value"] << 32 * r["limb"])
        return out

    def run(self, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> list[list[int]]:
        """The centroids after `rounds` rounds; fewer than k only if there are fewer vectors."""
        now, before = self.first_centroids(k, seed), None
        sums: dict[tuple[int, int], int] = {}
        for _ in range(rounds if now else 0):
            for at, change in self.move(before, now).items():
                sums[at] = sums.get(at, 0) + change
            before = now
            count = [sums.get((c, -1), 0) for c in range(len(now))]
            now = [[sums[c, d] // count[c] for d in range(self.dims)] if count[c] else now[c] for c in range(len(now))]
            if now == before:  # further rounds change nothing
                break
        return now


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS,
             bits: int = BITS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors are usable with exactly `dims` components, none null or
    non-finite; the others have no row. Components count as floor(1024 * x).

    * ties: the smaller centroid number; of ids with one digest the smaller
      vector is the earlier centroid;
    * null vec_id: clustered, but never a first centroid; without any id
      there is no centroid and no row;
    * repeated rows: each is a vector of its own;
    * fewer vectors than k: as many centroids as vectors; empty clusters keep
      their centroid;
    * components of any finite size: worked with exactly; a squared distance
      or a sum of them that exceeds 64 bits is null;
    * empty table: no rows; further columns are ignored.
    """
    file = Clustering(vectors, dims, bits, vec_id, vector)
    final = file.run(k, rounds, seed)
    spark = file.table.sparkSession
    schema = f"vec_id {file.table.schema['vec_id'].dataType.simpleString()}, cluster int, square decimal(38,0)"
    if final:
        labelled = file.table.select("vec_id", "v", "cells").mapInArrow(_assigning(file.edges, final, dims, bits), schema)
    else:
        labelled = spark.createDataFrame([], schema)
    labelled = stored(labelled)
    digests = spark.createDataFrame([(c, centroid_digest(row)) for c, row in enumerate(final)], "cluster int, centroid_sha256 string")
    # one row a cluster; a sum with a part that is null, or beyond 64 bits, is null
    fits = lambda total, lost: F.when((lost == 0) & (total <= LARGEST), total).cast("long")
    totals = cut_lineage(
        labelled.groupBy("cluster").agg(F.sum("square").alias("s"), F.count_if(F.col("square").isNull()).alias("lost"))
        .select("cluster", fits(F.col("s"), F.col("lost")).alias("cluster_inertia"),
                fits(F.expr("sum(s) over ()"), F.expr("sum(lost) over ()")).alias("inertia"))
        .join(F.broadcast(digests), "cluster")
    )
    return labelled.join(F.broadcast(totals), "cluster").select(
        "vec_id", "cluster", F.col("square").cast("long").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


def _assigning(edges: list[list[float]], final: list[list[int]], dims: int, bits: int):
    """Batches of (vec_id, v, cells) to (vec_id, cluster, square): full comparison only where intervals overlap."""
    least, greatest = tables(edges, final)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of(batch.column("v"), dims)
            best, several = undecided(unpacked(batch.column("cells"), dims, bits), least, greatest)
            square = np.zeros(len(x), object)
            if several.any():
                best[several], square[several] = nearest(x[several], final)
            for c in np.unique(best[~several]).tolist():  # the distance to the only one in reach
                own = ~several & (best == c)
                square[own] = square_distances(x[own], [final[c]])[:, 0]
            square = pa.array([s if s <= LARGEST else None for s in map(int, square.tolist())], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(best, pa.int32()), square.cast(pa.decimal128(38, 0))], ["vec_id", "cluster", "square"])

    return run


def _rounds_sql(rounds: int) -> str:
    steps = []
    for r in range(rounds):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT row, c FROM x, c{r} QUALIFY row_number() OVER (PARTITION BY row ORDER BY {_SQUARE}, c) = 1),
s{r} AS (SELECT c, d, sum(v[d]) AS s, count(*) AS n FROM a{r} JOIN x USING (row), range(1, {DIMS + 1}) r(d) GROUP BY ALL),
m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY d) AS e FROM s{r} GROUP BY 1),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m{r}.e, c{r}.e) AS e FROM c{r} LEFT JOIN m{r} USING (c))""")
    return ",".join(steps)


_SQUARE = "list_sum(list_transform(list_zip(v, e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
SQL = f"""
WITH x AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda f: floor(1024 * f::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda f: f IS NOT NULL AND isfinite(f))) = {DIMS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS c, v AS e FROM x
                    WHERE vec_id IS NOT NULL QUALIFY c < {CLUSTERS}),{_rounds_sql(ROUNDS)},
ends AS MATERIALIZED (SELECT vec_id, c, {_SQUARE}::BIGINT AS distance, e FROM x, c{ROUNDS}
                      QUALIFY row_number() OVER (PARTITION BY row ORDER BY {_SQUARE}, c) = 1)
SELECT vec_id, c::INT AS cluster, distance, sum(distance) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(e, ',')) AS centroid_sha256
FROM ends
"""
