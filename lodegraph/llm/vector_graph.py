"""Embedding near-dedup over a robust-pruned flat graph.

Equal vectors form a class first. The classes are dealt to overlapping cluster
shards; each shard builds a graph in which a node keeps the neighbours that no
nearer neighbour already leads to (robust pruning). The adjacency lists of all
shards are united by node. Every vector is then searched for in the shards of
its nearest centres: a greedy search from the shard's medoid over the united
lists, and from all that lies in range an expansion that follows the lists as
long as they stay in range. Links are verified in double precision. A vector's
links are counted in the linked vector's home shard only, so overlaps do not
count twice. Last, recall is audited against brute force on a sample of
vectors; below the target, the search is repeated in twice as many shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import components
from lodegraph.llm.minhash_forest import runs
from lodegraph.session import cut_lineage

COSINE = 0.95
# vectors a shard aims at; centres at most; vectors sampled for each centre
SHARD, CENTRES, SAMPLED = 1000, 16_384, 16
SPLIT = 4096  # members of a shard, at home or not, beyond which it is dealt to several tasks
OVERLAP, PROBES = 2, 4
DEGREE, ALPHA, POOL = 24, 1.2, 64
BEAM, WIDTH, BLOCK = 32, 4, 256
WIDER = 0.05  # the expansion passes through neighbours this much out of range
AUDITED, RECALL = 1024, 0.98
# elements that a table of intermediate results may have; neighbours followed at once
TABLE, FOLLOWED = 1 << 20, 1 << 18


def unit(binaries: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(binaries), np.float64).reshape(len(binaries), -1)


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of whose rows a table with `width` columns has no more than TABLE elements."""
    step = max(1, TABLE // max(1, width))
    for batch in batches:
        for begin in range(0, batch.num_rows, step):
            yield batch.slice(begin, step)


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, node) and classes (node, weight, v): v is the unit vector in
    double precision; node is null where the vector links with nothing."""
    e = F.col("e")
    usable = F.coalesce((F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    node = F.concat(F.hex(F.xxhash64(e)), F.hex(F.xxhash64(e, F.lit(1))))
    rows = vectors.select("vec_id", "e", F.when(usable, node).alias("node"))
    dimension = rows.where("node is not null").agg(F.max(F.size("e"))).first()[0] or 0

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, dimension):
            lists = batch.column("e").to_pylist()
            out = np.zeros((len(lists), dimension))
            for i, own in enumerate(lists):
                out[i, : len(own)] = own
            out /= np.abs(out).max(axis=1, keepdims=True)  # so that no square over- or underflows
            out /= np.linalg.norm(out, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("weight"), pa.array([x.tobytes() for x in out], pa.binary())], ["node", "weight", "v"])

    grouped = rows.where("node is not null").groupBy("node", "e").agg(F.count(F.lit(1)).alias("weight"))
    return rows.select("vec_id", "node"), cut_lineage(grouped.mapInArrow(units, "node string, weight long, v binary"))


def centres(nodes: DataFrame, count: int) -> np.ndarray:
    """Spherical k-means on a bounded sample, SAMPLED vectors for each of at most CENTRES centres."""
    k = int(min(CENTRES, max(1, count // SHARD)))
    share = min(1.0, 1.3 * SAMPLED * k / max(1, count))
    drawn = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(share * (1 << 30))).select("node", "v").limit(2 * SAMPLED * k).collect()
    data = unit([r["v"] for r in sorted(drawn, key=lambda r: r["node"])]).astype(np.float32)
    k = min(k, len(data))
    found = data[np.random.default_rng(5).permutation(len(data))[:k]].copy()
    for _ in range(8):
        nearest = np.concatenate([(data[i : i + 4096] @ found.T).argmax(axis=1) for i in range(0, len(data), 4096)])
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, data)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(norms > 0, sums / np.maximum(norms, 1e-12), found)
    return found


def placed(nodes: DataFrame, held, ranks: int) -> DataFrame:
    """(node, weight, v, shard, rank): the `ranks` nearest centres of each class, rank 0 is its home."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, len(held.value)):
            sims = unit(batch.column("v").to_pylist()).astype(np.float32) @ held.value.T
            n = min(ranks, sims.shape[1])
            order = np.argsort(-sims, axis=1, kind="stable")[:, :n]
            for rank in range(n):
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("node", "weight", "v")), pa.array(order[:, rank], pa.int32()), pa.array(np.full(batch.num_rows, rank), pa.int32())],
                    ["node", "weight", "v", "shard", "rank"],
                )

    return nodes.mapInArrow(run, "node string, weight long, v binary, shard int, rank int")


def pruned(data: np.ndarray) -> list[np.ndarray]:
    """Adjacency of a shard's graph: robust pruning of the nearest, reverse edges, and a path from the medoid to every node."""
    m = len(data)
    sims = data @ data.T
    np.fill_diagonal(sims, -2)
    pool = min(POOL, m - 1)
    if pool < 1:
        return [np.empty(0, np.int64)] * m
    step = max(1, TABLE // m)
    near = np.concatenate([np.argpartition(-sims[i : i + step], pool - 1, axis=1)[:, :pool] for i in range(0, m, step)])
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
    far = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(sims, near, 1)))
    alive, kept = np.ones((m, pool), bool), np.zeros((m, pool), bool)
    every = np.arange(m)
    for _ in range(DEGREE):
        first = alive.argmax(axis=1)
        some = alive[every, first]
        if not some.any():
            break
        rows, cols = every[some], first[some]
        kept[rows, cols] = True
        alive[rows, cols] = False
        between = np.sqrt(np.maximum(0, 2 - 2 * sims[near[rows, cols][:, None], near[rows]]))
        alive[rows] &= ALPHA * between > far[rows]
    edges = [set(near[i, kept[i]].tolist()) for i in range(m)]
    for i in range(m):
        for j in near[i, kept[i]][: DEGREE // 2].tolist():
            edges[j].add(i)
    lists = [np.array(sorted(e), np.int64) for e in edges]
    start = int((data @ data.mean(axis=0)).argmax())
    reached = np.zeros(m, bool)
    stack = [start]
    while True:
        while stack:
            i = stack.pop()
            if not reached[i]:
                reached[i] = True
                stack.extend(lists[i][~reached[lists[i]]].tolist())
        if reached.all():
            return lists
        lost = np.flatnonzero(~reached)
        known = np.flatnonzero(reached)
        best = sims[np.ix_(lost, known)]
        at = np.unravel_index(best.argmax(), best.shape)
        i, j = int(known[at[1]]), int(lost[at[0]])
        lists[i] = np.append(lists[i], j)
        stack = [j]


def _names(batch: pa.RecordBatch) -> list:
    return list(zip(*(batch.column(c).to_pylist() for c in ("shard", "part", "asks"))))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in runs(batches, _names):
        nodes = run.column("node").to_pylist()
        lists = pruned(unit(run.column("v").to_pylist()).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes), pa.array([[nodes[j] for j in own] for own in lists], pa.list_(pa.string()))], ["node", "near"]
        )


class Shard:
    """The members of a shard with the united lists, ready for searches."""

    def __init__(self, run: pa.Table):
        self.nodes = run.column("node").to_pylist()
        self.exact = unit(run.column("v").to_pylist())
        self.data = self.exact.astype(np.float32)
        self.home = np.array(run.column("rank").to_pylist()) == 0
        self.weight = np.array(run.column("weight").to_pylist(), np.int64)
        place = {node: i for i, node in enumerate(self.nodes)}
        lists = [[place[x] for x in own or () if x in place] for own in run.column("near").to_pylist()]
        # one list after another: a hub's may be as long as the shard
        self.near = np.array([x for own in lists for x in own], np.int64)
        self.degree = np.array([len(own) for own in lists], np.int64)
        self.first = np.cumsum(self.degree) - self.degree
        self.medoid = int((self.data @ self.data.mean(axis=0)).argmax())

    def in_range(self, asked: np.ndarray, cosine: float) -> np.ndarray:
        """Which members (columns) the greedy search and the expansion find in range of which vectors (rows)."""
        b, m = len(asked), len(self.nodes)
        seen = np.zeros((b, m), bool)
        known = seen.reshape(-1)
        step = max(1, TABLE // asked.shape[1])
        sims = np.full((b, m), -2, np.float32)
        rows = np.arange(b)
        seen[:, self.medoid] = True
        sims[:, self.medoid] = asked @ self.data[self.medoid]
        beam = np.full((b, BEAM), self.medoid)
        open_ = np.zeros((b, BEAM), bool)
        open_[:, 0] = True

        def look(q: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Visits the unseen neighbours of members `at` for vectors q, some FOLLOWED at a time; returns the new pairs."""
            new, upto, begin = [], np.cumsum(self.degree[at]), 0
            while begin < len(q):
                past = upto[begin] - self.degree[at[begin]] + FOLLOWED
                end = max(begin + 1, int(np.searchsorted(upto, past, side="right")))
                from_, n = at[begin:end], self.degree[at[begin:end]]
                place = np.repeat(self.first[from_] - np.cumsum(n) + n, n) + np.arange(n.sum())
                pair = np.repeat(q[begin:end] * m, n) + self.near[place]
                pair = np.unique(pair[~known[pair]])
                known[pair] = True
                new.append(pair)
                begin = end
            pair = np.concatenate(new) if new else np.empty(0, np.int64)
            q, at = pair // m, pair % m
            for i in range(0, len(q), step):
                sims[q[i : i + step], at[i : i + step]] = np.einsum("ij,ij->i", asked[q[i : i + step]], self.data[at[i : i + step]])
            return q, at

        done = np.zeros((b, m), bool)
        while open_.any():
            q, slot = np.nonzero(open_)
            best = sims[q, beam[q, slot]]
            order = np.lexsort((-best, q))
            q, slot = q[order], slot[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            q, slot = q[rank < WIDTH], slot[rank < WIDTH]
            at = beam[q, slot]
            done[q, at] = True
            look(q, at)
            width = min(BEAM, m)
            beam = np.argpartition(-sims, width - 1, axis=1)[:, :width]
            open_ = seen[rows[:, None], beam] & ~done[rows[:, None], beam]
        q, at = np.nonzero(sims >= cosine - WIDER)
        fresh = ~done[q, at]
        q, at = q[fresh], at[fresh]
        while len(q):
            done[q, at] = True
            q, at = look(q, at)
            wide = sims[q, at] >= cosine - WIDER
            q, at = q[wide], at[wide]
        return sims >= cosine - 1e-4


def _searches(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for group in runs(batches, _names, BLOCK):
            if not group.column("asks")[0].as_py():
                shard, key = Shard(group), (group.column("shard")[0].as_py(), group.column("part")[0].as_py())
                parent = {}
                continue
            if shard is None or key != (group.column("shard")[0].as_py(), group.column("part")[0].as_py()):
                continue  # nobody lives here
            nodes, exact = group.column("node").to_pylist(), unit(group.column("v").to_pylist())
            found = shard.in_range(exact.astype(np.float32), cosine)
            found[:, ~shard.home] = False
            counts, left, right = np.zeros(len(nodes), np.int64), [], []

            def root(x: str) -> str:
                while (up := parent.get(x, x)) != x:
                    parent[x] = parent.get(up, up)
                    x = up
                return x

            for i, node in enumerate(nodes):
                at = np.flatnonzero(found[i])
                at = at[shard.exact[at] @ exact[i] >= cosine]
                at = at[[shard.nodes[j] != node for j in at]] if len(at) else at
                counts[i] = shard.weight[at].sum()
                for j in at:
                    x, y = root(node), root(shard.nodes[j])
                    if x != y:
                        parent[x] = y
                        left.append(node)
                        right.append(shard.nodes[j])
            n = len(nodes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes + left), pa.array([None] * n + right, pa.string()), pa.array([*counts.tolist(), *[0] * len(left)], pa.int64())],
                ["node", "other", "links"],
            )

    return run


def _dealt(places: DataFrame, sizes: DataFrame, everywhere: bool) -> DataFrame:
    """Adds `part`: members of a large shard go to one of its parts, searches to all of them."""
    parts = F.coalesce("parts", F.lit(1))
    part = F.explode(F.sequence(F.lit(0), parts - 1)) if everywhere else F.pmod(F.xxhash64("node"), parts).cast("int")
    return places.join(F.broadcast(sizes), "shard", "left").withColumn("part", part).drop("parts")


def _found(nodes: DataFrame, held, members: DataFrame, near: DataFrame, sizes: DataFrame, probes: int, cosine: float) -> DataFrame:
    queries = _dealt(placed(nodes, held, probes), sizes, True).select(
        "shard", "part", F.lit(True).alias("asks"), "node", "weight", "v", "rank", F.lit(None).cast("array<string>").alias("near")
    )
    lists = members.join(near, "node", "left").select("shard", "part", F.lit(False).alias("asks"), "node", "weight", "v", "rank", "near")
    both = lists.union(queries).repartition("shard", "part").sortWithinPartitions("shard", "part", "asks")
    return cut_lineage(both.mapInArrow(_searches(cosine), "node string, other string, links long"))


def audit(nodes: DataFrame, counted: DataFrame, cosine: float = COSINE, audited: int = AUDITED) -> float:
    """Recall of the counted links on a bounded sample of classes, against all of them."""
    sample = nodes.join(counted, "node", "left").orderBy(F.xxhash64("node", F.lit(3))).limit(audited).collect()
    if not sample:
        return 1.0
    held = nodes.sparkSession.sparkContext.broadcast([(r["node"], r["v"]) for r in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, data = [x[0] for x in held.value], unit([x[1] for x in held.value])
        total = np.zeros(len(names), np.int64)
        for batch in _pieces(batches, len(names)):
            weight = np.array(batch.column("weight").to_pylist(), np.int64)
            other = np.array(batch.column("node").to_pylist())[None, :] != np.array(names)[:, None]
            total += ((data @ unit(batch.column("v").to_pylist()).T >= cosine) & other) @ weight
        yield pa.RecordBatch.from_arrays([pa.array([int(total[i]) for i in range(len(names))], pa.int64()), pa.array(range(len(names)), pa.int32())], ["links", "at"])

    true = {r["at"]: r["n"] for r in nodes.mapInArrow(run, "links long, at int").groupBy("at").agg(F.sum("links").alias("n")).collect()}
    wanted = sum(true.values())
    return sum(min(r["links"] or 0, true[i]) for i, r in enumerate(sample)) / wanted if wanted else 1.0


def near_vectors(vectors: DataFrame, cosine: float = COSINE, probes: int = PROBES, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    n_links counts the other rows with a cosine of `cosine` or more,
    component_id is the smallest vec_id that links reach, kept where it is the
    row's own.

    * null, empty or zero vectors, and vectors with null, NaN or infinite
      components: linked with nothing, kept;
    * vectors of different length are compared as if padded with zeros;
    * equal vectors and repeated rows: linked with each other; rows of the
      kept id are all kept; null vec_id: linked, never kept unless unusable;
    * empty table: no rows; further columns are ignored.
    """
    vectors = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    rows, nodes = classes(vectors)
    count = nodes.count()
    if count:
        groups, counted = _links(nodes, count, cosine, probes)
    else:
        groups = nodes.select(F.col("node").alias("id"), F.col("node").alias("component_id"))
        counted = nodes.select("node", F.lit(0).cast("long").alias("links"))
    joined = (
        rows.join(nodes.select("node", "weight"), "node", "left").join(counted, "node", "left")
        .join(groups.withColumnRenamed("component_id", "root"), F.col("node") == F.col("id"), "left")
    )
    row = cut_lineage(joined.select(
        "vec_id", F.coalesce(F.col("links"), F.lit(0)).alias("links"), F.coalesce(F.col("weight") - 1, F.lit(0)).alias("copies"), F.coalesce("root", "node").alias("root")
    ))
    first = cut_lineage(row.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("first")))
    own = row.join(first, "root", "left").select(
        "vec_id", (F.col("links") + F.col("copies")).alias("n_links"), F.col("root").isNull().alias("alone"),
        F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("first")).alias("component_id"),
    )
    return own.select("vec_id", "n_links", "component_id", (F.col("alone") | F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))).alias("kept"))


def _links(nodes: DataFrame, count: int, cosine: float, probes: int) -> tuple[DataFrame, DataFrame]:
    """Components of the classes, and links per class, at the audited recall."""
    held = nodes.sparkSession.sparkContext.broadcast(centres(nodes, count))
    shards = len(held.value)
    places = cut_lineage(placed(nodes, held, OVERLAP))
    # one row for each of at most CENTRES shards
    sizes = cut_lineage(places.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("parts")))
    members = cut_lineage(_dealt(places, sizes, False).withColumn("asks", F.lit(False)))
    built = members.repartition("shard", "part").sortWithinPartitions("shard", "part").mapInArrow(_build, "node string, near array<string>")
    near = cut_lineage(built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
    while True:
        probes = min(probes, shards)
        found = _found(nodes, held, members, near, sizes, probes, cosine)
        counted = cut_lineage(found.where("other is null").groupBy("node").agg(F.sum("links").alias("links")))
        if probes == shards or audit(nodes, counted, cosine) >= RECALL:
            break
        probes *= 2
    return components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))), counted
