"""Divergence of sources by a K-squared quadtree over the group-term count matrix.

A group is a (lang, source); its row of the matrix counts the terms its
language keeps. The matrix is sparse: most of it is quadrants without any
count. Terms are dealt to blocks, and a block's part of the matrix becomes a
K-squared tree, a bitmap of its non-empty quadrants level by level. Two rows
are compared by walking the tree jointly: where both quadrants are empty all
their cells cost the same and are priced at once by their number, other
quadrants are parted in four, and single cells are compared exactly.

Whole rows are never gathered: a task holds one block of terms for two blocks
of groups, and adds up what it has priced for each pair of groups.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.llm.common import rebatched, stored

UNIT, LEAST_DOCS, TOP_TERMS = 1_000_000_000, 3, 200
BLOCK_TERMS, BLOCK_GROUPS = 8192, 256
# (term, group) counters a task holds before it passes them on, and states walked at once
COUNTERS, STATES = 400_000, 1 << 17
# rows of some 60 bytes up to which the table of groups is broadcast
BROADCAST_ROWS = 200_000

# bytes of terms, A-Z in lower case; all others part terms. In UTF-8 bytes from 0x80 on are letters of other scripts.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, df), folded within tasks; a null term stands for the group itself."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))],
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def passed_on(held: dict) -> pa.RecordBatch:
        out = [(*group, term, n, df[term]) for group, (counts, df) in held.items() for term, n in counts.items()]
        out += [(*group, None, 0, 0) for group in held]
        columns = list(zip(*out)) if out else [[]] * 5
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "source", "term", "n", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        for batch in rebatched(batches, "text", 4 << 20):
            texts = batch.column("text").to_pylist()
            for group, text in zip(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()), texts):
                counts, df = held.setdefault(group, (Counter(), Counter()))
                words = terms_of(text)
                counts.update(words)
                df.update(set(words))
            if sum(len(c) for c, _ in held.values()) > COUNTERS:
                yield passed_on(held)
                held = {}
        yield passed_on(held)

    return rows.mapInArrow(run, "lang string, source string, term binary, n long, df long").withColumn("term", F.col("term").cast("string"))


def _weight(count: str, total: str, terms: str) -> F.Column:
    """p = 1 + floor(UNIT * (count + 1) / (total + terms)), exact beyond 64 bits."""
    return F.expr(f"cast(1 + (cast({UNIT} AS decimal(20,0)) * ({count} + 1)) div cast({total} + {terms} AS decimal(20,0)) AS bigint)")


def _shared(df: DataFrame) -> DataFrame:
    """A broadcast of the table if it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def tree(rows: np.ndarray, columns: np.ndarray, levels: int) -> list[np.ndarray]:
    """Sorted numbers (row << level | column) of the non-empty quadrants, from the whole square down to cells."""
    out = []
    for level in range(levels + 1):
        shift = levels - level
        out.append(np.unique((rows >> shift) << level | columns >> shift))
    return out


def _among(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    at = np.searchsorted(found, keys)
    return found[np.minimum(at, len(found) - 1)] == keys if len(found) else np.zeros(len(keys), bool)


def joint_walk(rows: np.ndarray, columns: np.ndarray, weights: np.ndarray, empty: np.ndarray, terms: int, states: int = STATES) -> np.ndarray:
    """Sums over `terms` columns of floor((p - q) * (p - q) / q): entry (a, b) has p of row a and q of row b.

    (rows, columns, weights) are the non-empty cells; elsewhere row r weighs empty[r].
    """
    n = len(empty)
    levels = int(max(n, terms, 1) - 1).bit_length()
    quadrants = tree(rows, columns, levels)
    order = np.argsort(rows << levels | columns)
    weights = weights[order]
    total, zeros = np.zeros((n, n), np.int64), np.zeros((n + 1, n + 1), np.int64)
    first = np.zeros(1, np.int64)
    stack = [(0, first, first, first)] if terms else []
    while stack:
        level, a, b, c = stack.pop()
        if len(a) > states:  # a part at a time, so that what is held stays bounded
            stack.append((level, a[states:], b[states:], c[states:]))
            a, b, c = a[:states], b[:states], c[:states]
        in_a, in_b = (_among(r << level | c, quadrants[level]) for r in (a, b))
        height = 1 << levels - level
        blank = ~in_a & ~in_b
        if blank.any():
            # all pairs of the two ranges of rows have as many cells alike: a difference array over rectangles
            width = np.minimum((c[blank] + 1) * height, terms) - c[blank] * height
            top, left = a[blank] * height, b[blank] * height
            low, right = np.minimum(top + height, n), np.minimum(left + height, n)
            for r, s, sign in ((top, left, 1), (top, right, -1), (low, left, -1), (low, right, 1)):
                np.add.at(zeros, (r, s), sign * width)
        a, b, c = a[~blank], b[~blank], c[~blank]
        if level == levels:
            other = a != b
            a, b, c = a[other], b[other], c[other]
            p, q = (_cell(r, c, level, quadrants[level], weights, empty) for r in (a, b))
            gap = (p - q) * (p - q)
            np.add.at(total, (a, b), gap // q)
            np.add.at(total, (b, a), gap // p)
        elif len(a):
            down = [(2 * a + i, 2 * b + j, 2 * c + k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
            a, b, c = (np.concatenate(x) for x in zip(*down))
            half = height // 2
            real = (a <= b) & (b * half < n) & (a * half < n) & (c * half < terms)
            stack.append((level + 1, a[real], b[real], c[real]))
    alike = np.triu(zeros[:n, :n].cumsum(axis=0).cumsum(axis=1), 1)
    alike += alike.T
    gap = (empty[:, None] - empty[None, :]) ** 2
    return total + alike * (gap // empty[None, :])


def _cell(r, c, level, cells, weights, empty) -> np.ndarray:
    keys = r << level | c
    at = np.minimum(np.searchsorted(cells, keys), max(len(cells) - 1, 0))
    return np.where(cells[at] == keys, weights[at], empty[r])


def _pairs_of_tile(key, table):
    """Sums over one block of terms for all pairs of two blocks of groups, which the key names."""
    lang, first, second = key[0].as_py(), key[2].as_py(), key[3].as_py()
    number = table.column("number").to_numpy()
    weight, is_group = table.column("p").to_numpy(), table.column("term").is_null().to_numpy()
    groups, empty = number[is_group], weight[is_group]
    order = np.argsort(groups)
    groups, empty = groups[order], empty[order]
    # terms that only groups of other blocks have count as well
    terms = pa.compute.max(table.column("of_block")).as_py() or 0
    cells = table.filter(pa.array(~is_group))
    columns = cells.column("term").combine_chunks().dictionary_encode()
    rows = np.searchsorted(groups, number[~is_group])
    sums = joint_walk(rows, columns.indices.to_numpy(zero_copy_only=False).astype(np.int64), weight[~is_group], empty, terms)
    block = groups // BLOCK_GROUPS
    a, b = np.nonzero((block[:, None] == first) & (block[None, :] == second) | (block[:, None] == second) & (block[None, :] == first))
    a, b = a[a != b], b[a != b]
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "number": groups[a], "other": groups[b], "value": sums[a, b]})


class Matrix:
    """The counts of all groups and kept terms, as stored tables.

    cells: lang, source, term, n (over 0), lang_n, leads; groups: lang, source,
    number (from 0 within the language), total, terms, lang_total, of_lang
    (groups of the language), empty (p of a count of 0).
    """

    def __init__(self, docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS):
        folded = stored(counted(docs, text, lang, source))
        of_term = Window.partitionBy("lang", "term")
        self.cells = stored(
            # one shuffle by (lang, term): it serves the sums by group and those of the language
            folded.where("term is not null").repartition("lang", "term")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
            .withColumn("lang_n", F.sum("n").over(of_term)).withColumn("lang_df", F.sum("df").over(of_term))
            .withColumn("leads", F.col("source") == F.min("source").over(of_term))  # one cell of each term
            .where(F.col("lang_df") >= least_docs).drop("df", "lang_df")
        )
        langs = self.cells.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("leads").alias("terms"))
        totals = self.cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        in_order = Window.partitionBy("lang").orderBy("source")
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        self.groups = stored(
            folded.where("term is null").select("lang", "source").distinct()
            .withColumn("number", F.row_number().over(in_order).cast("long") - 1)
            .withColumn("of_lang", F.count(F.lit(1)).over(Window.partitionBy("lang")))
            .join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
            .select("lang", "source", "number", "of_lang", zero("total"), zero("lang_total"), zero("terms"))
            .withColumn("empty", F.when(F.col("terms") > 0, _weight("0", "total", "terms")))
        )

    def weighted(self) -> DataFrame:
        """The cells with p, the group's number and what else its row of `groups` says."""
        return self.cells.join(_shared(self.groups), ["lang", "source"]).withColumn("p", _weight("n", "total", "terms"))

    def pairs(self) -> DataFrame:
        """(lang, source, item, value) of each source and each other one of its language."""
        blocks = f"greatest(1, (terms + {BLOCK_TERMS - 1}) DIV {BLOCK_TERMS})"
        # a tile holds two blocks of groups; (i, j) and (j, i) are one
        tiles = F.expr(f"""transform(sequence(0, (of_lang - 1) DIV {BLOCK_GROUPS}), j -> named_struct(
            'first', least(j, number DIV {BLOCK_GROUPS}), 'second', greatest(j, number DIV {BLOCK_GROUPS})))""")
        block = F.expr(f"pmod(xxhash64(term), {blocks})").alias("block")
        cells = self.weighted().select("lang", "number", "term", "p", block, F.explode(tiles).alias("t"), F.lit(None).cast("long").alias("of_block"))
        sizes = self.cells.where("leads").join(_shared(self.groups.select("lang", "terms").distinct()), "lang") \
            .groupBy("lang", block).agg(F.count(F.lit(1)).alias("of_block"))
        rows = self.groups.select("lang", "number", F.lit(None).cast("string").alias("term"), F.coalesce("empty", F.lit(1).cast("long")).alias("p"),
                                  F.explode(F.expr(f"sequence(cast(0 AS bigint), {blocks} - 1)")).alias("block"), tiles.alias("t"))
        rows = rows.withColumn("t", F.explode("t")).join(sizes, ["lang", "block"], "left")
        sums = (
            cells.unionByName(rows).select("lang", "block", "t.first", "t.second", "number", "term", "p", "of_block")
            .groupBy("lang", "block", "first", "second")
            .applyInArrow(_pairs_of_tile, "lang string, number long, other long, value long")
            .groupBy("lang", "number", "other").agg(F.sum("value").alias("value"))
        )
        names = _shared(self.groups.select("lang", "number", "source"))
        return sums.join(names, ["lang", "number"]).join(
            names.select("lang", F.col("number").alias("other"), F.col("source").alias("item")), ["lang", "other"]
        ).select("lang", "source", "item", "value")

    def terms(self) -> DataFrame:
        """(lang, source, item, value) of the terms a group has more of than its language."""
        q = _weight("lang_n", "lang_total", "terms")
        return self.weighted().withColumn("q", q).where("p > q").select(
            "lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", top: int = TOP_TERMS) -> DataFrame:
    """Rows lang, source, part, item, value, rank: how far a group is from others ('pair') and by which terms ('term').

    All pairs of sources of a language are listed, as are each group's `top` terms.

    * null text, lang or source: the empty string; empty texts have no terms,
      their groups are listed all the same;
    * a language without kept terms: its pairs have the value 0;
    * a language with one source: no pairs; ties: by item, in UTF-8 order;
    * null doc_id and repeated rows: each row is a document of its own;
    * very long texts: counted whole, a text at a time;
    * empty table: no rows; further columns are ignored.
    """
    matrix = Matrix(docs, text, lang, source)
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    ranked = lambda df, part: df.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    # the cut by rank acts in every task before the shuffle
    return ranked(matrix.pairs(), "pair").unionByName(ranked(matrix.terms(), "term").where(F.col("rank") <= top))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT row, lang, source, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM words GROUP BY 1, 2 HAVING count(DISTINCT row) >= {LEAST_DOCS}),
cells AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, sum(n)::BIGINT AS total, count(*) AS v FROM kept GROUP BY 1),
g AS MATERIALIZED (SELECT x.lang, x.source, coalesce(sum(n), 0)::BIGINT AS total FROM (SELECT DISTINCT lang, source FROM d) x
                   LEFT JOIN cells USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
        (1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + l.v))::HUGEINT AS p,
        (1 + ({UNIT}::HUGEINT * (kept.n + 1)) // (l.total + l.v))::HUGEINT AS q
      FROM g JOIN kept USING (lang) JOIN langs l USING (lang) LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM parts QUALIFY part = 'pair' OR rank <= {TOP_TERMS}
"""
