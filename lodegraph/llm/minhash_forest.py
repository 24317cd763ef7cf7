"""Near-dedup by an LSH forest over MinHash signatures.

1. Every text becomes its set of hashed word shingles; texts with one set form
   a class, and only classes go on.
2. Each of TREES trees orders the classes by its own part of their signatures.
   The order is cut into tasks by range, so a dense part of it spreads over
   tasks by itself. Neighbours with a common prefix are candidates: of length
   two where few share it, of length three where many do.
3. Within a run of candidates only a spanning forest of the pairs whose
   signatures agree is kept. Its components, over all trees, are blocks: no
   pair of similar classes lies in two of them.
4. Each block's full sets meet in one task, which finds the exact links; blocks
   above TILE members are dealt to tiles. Every link between tiles either joins
   two members of the block's largest component, which are connected anyway, or
   has an end outside it, and those few are sent to all tiles.
5. The links' components are the groups of near copies.

A pair of similarity 0.8 is a candidate in one tree with probability 0.51 at
depth three, so 20 trees miss it with probability 6e-7.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import components, once, rebatched, rows_left, texts
from lodegraph.session import cut_lineage

TREES, DEPTH = 20, 4
# members of a two-value prefix from which on three values are asked for
DENSE = 256
# bytes of signature that travel with a row of a tree, and their least agreement; for a
# similarity of 0.8 the agreement is below 0.55 once in 3 million pairs
SKETCH, AGREE = 64, 0.55
TILE, HUBS = 512, 24
ROOM = 1 << 16
MIX = 0x9E3779B97F4A7C15


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `words` words; A to Z count as a to z."""
    tokens = text.encode("utf-8", "replace").lower().split()
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, n)
    width = min(words, n)
    total = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        total = (total ^ (total >> np.uint64(29))) * np.uint64(MIX) + hashes[j : n - width + 1 + j]
    return np.unique(total ^ (total >> np.uint64(32)))


def constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    values = rng.integers(0, 1 << 63, (2, TREES * DEPTH), np.uint64)
    return values[0][:, None], (values[1] | np.uint64(1))[:, None]


def signature(items: np.ndarray, flips: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """TREES x DEPTH minima, reduced to 16 bits each; in blocks, so long texts take no more memory."""
    least = np.full(len(flips), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 4096):
        np.minimum(least, ((items[None, at : at + 4096] ^ flips) * factors).min(axis=1), out=least)
    return ((least ^ (least >> np.uint64(31))) * np.uint64(MIX) >> np.uint64(48)).astype(">u2")


def _described(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, node (digest of the set, null if empty), signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips, factors = once(("minhash",), constants)
        for batch in rebatched(batches, "text", 4 << 20):
            sizes, nodes, signatures = [], [], []
            for text in batch.column("text").to_pylist():
                items = shingles(text, words)
                sizes.append(len(items))
                nodes.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                signatures.append(signature(items, flips, factors).tobytes() if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tk"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(signatures, pa.binary())],
                ["doc_id", "tk", "n", "node", "signature"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, tk long, n long, node binary, signature binary")


def _in_trees(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            signatures = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(rows, TREES * DEPTH * 2)
            sketches = pa.array([s.tobytes() for s in np.ascontiguousarray(signatures[:, 1 : 2 * SKETCH : 2])], pa.binary())
            for tree in range(TREES):
                part = np.ascontiguousarray(signatures[:, tree * DEPTH * 2 : (tree + 1) * DEPTH * 2])
                # the tree is the first byte of the key
                keys = pa.array([bytes([tree]) + p.tobytes() for p in part], pa.binary())
                yield pa.RecordBatch.from_arrays([keys, batch.column("node"), batch.column("n"), sketches], ["key", "node", "n", "sketch"])

    return nodes.mapInArrow(run, "key binary, node binary, n long, sketch binary")


def runs(batches: Iterator[pa.RecordBatch], name: Callable[[pa.RecordBatch], list], most: int | None = None) -> Iterator[pa.Table]:
    """The runs of rows of equal name, over the borders of batches.

    With `most`, a run whose name ends in a true value comes in pieces of that many rows.
    """
    held, last, size = [], None, 0
    for batch in batches:
        names = name(batch)
        begin = 0
        for i, own in enumerate(names):
            full = most is not None and size + i - begin >= most and own == last and bool(own[-1])
            if own != last or full:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, last, begin, size = [], own, i, 0
        if len(names) > begin:
            held.append(batch.slice(begin))
            size += len(names) - begin
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """A spanning forest of the graph in which near(i, others) marks the neighbours of i among `others`."""
    rest = np.arange(n)
    while len(rest) > 1:
        stack, rest = [int(rest[0])], rest[1:]
        while stack and len(rest):
            i = stack.pop()
            hit = near(i, rest)
            for j in rest[hit]:
                yield i, int(j)
                stack.append(int(j))
            rest = rest[~hit]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning pairs of the classes that share a prefix and whose sketches agree."""
    def region(nodes: list, sizes: np.ndarray, sketches: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
        def near(i: int, others: np.ndarray) -> np.ndarray:
            alike = (sketches[others] == sketches[i]).sum(axis=1) >= AGREE * SKETCH
            own, theirs = sizes[i], sizes[others]
            return alike & (np.minimum(own, theirs) * 100 >= 80 * np.maximum(own, theirs) - 1e-6)

        for i, j in forest(len(nodes), near):
            yield nodes[i], nodes[j]

    left, right = [], []
    for run in runs(batches, lambda b: [k[:5] for k in b.column("key").to_pylist()]):
        m = run.num_rows
        if m > 1:
            keys, nodes = run.column("key").to_pylist(), run.column("node").to_pylist()
            sizes = run.column("n").to_numpy()
            sketches = np.frombuffer(b"".join(run.column("sketch").to_pylist()), np.uint8).reshape(m, SKETCH)
            edges = [0, m] if m <= DENSE else [0, *[i for i in range(1, m) if keys[i][:7] != keys[i - 1][:7]], m]
            for b, e in zip(edges, edges[1:]):
                if e - b > 1:
                    for x, y in region(nodes[b:e], sizes[b:e], sketches[b:e]):
                        left.append(x)
                        right.append(y)
        if len(left) > ROOM:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])
            left, right = [], []
    yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning pairs of the exact links in each tile."""
    left, right = [], []
    names = lambda b: list(zip(b.column("block").to_pylist(), b.column("tile").to_pylist()))
    for run in runs(batches, names):
        m = run.num_rows
        if m < 2:
            continue
        nodes = run.column("node").to_pylist()
        sets = [np.frombuffer(s, np.uint64) for s in run.column("items").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        vocabulary, places = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        mark = np.zeros(len(vocabulary), np.int32)

        def near(i: int, others: np.ndarray) -> np.ndarray:
            own = places[starts[i] : ends[i]]
            mark[own] = 1
            if len(others) > m // 2:
                common = np.add.reduceat(mark[places], starts)[others]
            else:
                common = np.array([mark[places[starts[j] : ends[j]]].sum() for j in others])
            mark[own] = 0
            return 100 * common >= 80 * (sizes[i] + sizes[others] - common)

        for i, j in forest(m, near):
            left.append(nodes[i])
            right.append(nodes[j])
        if len(left) > ROOM:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])
            left, right = [], []
    yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])


def _sets(docs: DataFrame, described: DataFrame, blocks: DataFrame, words: int) -> DataFrame:
    """(block, node, items): the full set of every class in a block, once."""
    wanted = cut_lineage(
        described.where("node is not null").groupBy("node").agg(F.min(F.struct("tk", "doc_id")).alias("row"))
        .join(blocks.select(F.col("id").alias("node"), F.col("component_id").alias("block")), "node")
        .select("row.tk", F.col("row.doc_id").alias("own"), "node", "block")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, "text", 2 << 20):
            items = [shingles(t, words) for t in batch.column("text").to_pylist()]
            same = [xxhash.xxh3_128_digest(x.tobytes()) == node for x, node in zip(items, batch.column("node").to_pylist())]
            found = pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("node"), pa.array([x.tobytes() for x in items], pa.binary())], ["block", "node", "items"]
            )
            yield found.filter(pa.array(same, pa.bool_()))

    once = docs.join(wanted, (docs["tk"] == wanted["tk"]) & docs["doc_id"].eqNullSafe(wanted["own"])).select("block", "node", "text")
    return once.mapInArrow(run, "block binary, node binary, items binary")


def near_copies(docs: DataFrame, words: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Two texts are linked if their sets of `words`-word shingles have a Jaccard
    similarity of 0.8 or more; component_id is the smallest doc_id among the
    texts that links reach, kept where it is the row's own. A text of fewer
    words is one shingle.

    * null, empty and blank texts: no shingles, linked with nothing, each kept;
    * null doc_id: takes part in links; never kept unless its text is blank,
      and component_id is null if no reachable text has an id;
    * repeated rows: alike; rows of the kept id are all kept;
    * very long texts: whole, in bounded memory; empty table: no rows;
    * a similarity of exactly 0.8 links; further columns are ignored.
    """
    row = _grouped(docs, words, doc_id, text)
    first = cut_lineage(row.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")))
    out = row.join(first, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("root").isNull().alias("blank"),
    )
    return out.select("doc_id", "n_shingles", "component_id", (F.col("blank") | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))).alias("kept"))


def _grouped(docs: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, tk, n, root) of every row: root names the texts that links reach, null without shingles."""
    source = texts(docs, doc_id=doc_id, text=text).withColumn("tk", F.xxhash64("text"))
    described = cut_lineage(_described(source, words))
    nodes = cut_lineage(
        described.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("signature").alias("signature"))
    )
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = _in_trees(nodes).repartitionByRange(parts, "key").sortWithinPartitions("key")
    blocks = components(ordered.mapInArrow(_candidates, "a binary, b binary"))
    members = cut_lineage(_sets(source, described, blocks, words).dropDuplicates(["node"]))
    sizes = blocks.groupBy(F.col("component_id").alias("block")).agg(F.count(F.lit(1)).alias("m"))
    large = cut_lineage(sizes.where(F.col("m") > TILE).withColumn("tiles", F.ceil(F.col("m") / TILE).cast("int")))
    exact = lambda df: df.repartition("block", "tile").sortWithinPartitions("block", "tile").mapInArrow(_exact, "a binary, b binary")
    if large.isEmpty():
        links = exact(members.withColumn("tile", F.lit(0)))
    else:
        links = _tiled(members, large, exact)
    groups = components(links)
    row = described.join(groups.withColumnRenamed("component_id", "root"), F.col("node") == F.col("id"), "left")
    return cut_lineage(row.select("doc_id", "tk", "n", F.coalesce("root", "node").alias("root")))


def _tiled(members: DataFrame, large: DataFrame, exact: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Exact links where some blocks are too large for one task."""
    dealt = members.join(large, "block", "left")
    home = F.pmod(F.xxhash64("node"), F.coalesce("tiles", F.lit(1))).cast("int")
    everywhere = F.sequence(F.lit(0), F.col("tiles") - 1)
    hub = F.pmod(F.xxhash64("node", F.lit(1)), F.col("m")) < HUBS
    tile = F.explode(F.when(F.coalesce(hub, F.lit(False)), everywhere).otherwise(F.array(home))).alias("tile")
    first = cut_lineage(exact(dealt.select("block", "node", "items", tile)))
    found = components(first)
    inside = dealt.where("tiles is not null").select("block", "node").join(found, F.col("node") == F.col("id"), "left").select(
        "block", "node", F.coalesce("component_id", "node").alias("part")
    )
    counted = inside.groupBy("block", "part").agg(F.count(F.lit(1)).alias("size"))
    largest = cut_lineage(counted.groupBy("block").agg(F.max_by("part", F.struct("size", "part")).alias("part")))
    outside = cut_lineage(inside.join(largest, ["block", "part"], "left_anti").select("node", F.lit(True).alias("out")))
    again = dealt.where("tiles is not null").join(outside, "node", "left")
    tile = F.explode(F.when(F.col("out"), everywhere).otherwise(F.array(home))).alias("tile")
    return first.union(exact(again.select("block", "node", "items", tile)))


def without_near_copies(docs: DataFrame, words: int = 5) -> DataFrame:
    """One row of each group of near copies, with all its columns: that with the smallest doc_id.

    Decisions go back by id and text, so rows that share an id are judged each
    by their own text; of rows with the group's smallest id one stays. A row
    without an id stays only if no row of its group has one. Texts without a
    word are in no group, and all their rows stay.
    """
    rows = _grouped(docs, words, "doc_id", "text").where("root is not null").select("doc_id", F.col("tk").alias("digest"), "root")
    known = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    first = cut_lineage(rows.groupBy("root").agg(F.min(known).alias("first"), F.count(F.lit(1)).alias("n")))
    found = cut_lineage(rows.join(first.where("n > 1"), "root").select("doc_id", "digest", (known == F.col("first")).alias("stays")))
    gone = found.where("not stays").select("doc_id", "digest").distinct()
    again = cut_lineage(found.where("stays").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return rows_left(docs, F.xxhash64(F.coalesce("text", F.lit(""))), gone, again)
