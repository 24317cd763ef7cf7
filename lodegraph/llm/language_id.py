"""Language identification by prediction by partial matching (PPM).

One variable-order byte context tree per language: the probability of a byte
is taken from the longest context the tree knows, and every context that does
not know the byte charges its escape probability (method C: escapes weigh as
much as the context has distinct followers). The statistics are frozen after
training, so the exact code length of a byte given its context is a constant;
the trees are therefore kept as sorted tables of contexts with one code length
per language, and a text is scored by looking its windows up. The language
with the shortest code for the whole text wins.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.llm.common import once, rebatched

UNKNOWN = "und"
ORDER = 4
# the training sample: documents a language and all together, but LEAST of each language at least; characters an excerpt
DOCS_A_LANGUAGE, DOCS_IN_ALL, LEAST_A_LANGUAGE, EXCERPT = 300, 9_600, 20, 16_000
# a text that takes more than this under every language is explained by none: uniform bytes take as much
BITS_A_BYTE = 8.0
# start of every text, so that its first bytes have a full context too
PAD = b"\n" * ORDER
SCORED_AT_ONCE = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Rows found by 64-bit keys: a hashed slot first, a binary search for displaced keys."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.keys, self.rows = keys, rows
        self.shift = np.uint64(64 - max(4, int(len(keys)).bit_length() + 2))
        self.slots = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.slots[(keys * MIX) >> self.shift] = np.arange(len(keys), dtype=np.int32)
        self.displaced = bool(len(keys)) and (self.slots[(keys * MIX) >> self.shift] != np.arange(len(keys))).any()

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        at = self.slots[(keys * MIX) >> self.shift]
        if not len(self.keys):
            return at
        wrong = np.flatnonzero((at >= 0) & (self.keys[at] != keys))
        at[wrong] = -1
        if self.displaced and len(wrong):
            place = np.minimum(np.searchsorted(self.keys, keys[wrong]), len(self.keys) - 1)
            same = self.keys[place] == keys[wrong]
            at[wrong[same]] = place[same]
        return at


@dataclass
class Model:
    """languages; per order k: code lengths of k+1 bytes, escape lengths of k bytes (bits)."""

    languages: list[str]
    codes: list[Table]
    escapes: list[Table]

    def arrays(self) -> tuple:
        """What a broadcast carries: plain arrays, which executors can read without this package."""
        return self.languages, *[[(t.keys, t.rows) for t in tables] for tables in (self.codes, self.escapes)]

    @classmethod
    def of(cls, arrays: tuple) -> Model:
        languages, codes, escapes = arrays
        return cls(languages, [Table(*t) for t in codes], [Table(*t) for t in escapes])

    def lengths(self, data: np.ndarray) -> np.ndarray:
        """Code length of every byte from position ORDER on, a column per language."""
        window = np.zeros(len(data) - ORDER, np.uint64)
        for k in range(ORDER + 1):
            window = (window << np.uint64(8)) | data[k : len(data) - ORDER + k]
        out = np.zeros((len(window), len(self.languages)), np.float32)
        open_ = None  # positions whose byte is not found yet
        for k in range(ORDER, -1, -1):
            keys = window if k == ORDER else window & np.uint64((1 << (8 * (k + 1))) - 1)
            found = self.codes[k].find(keys)
            hit = found >= 0
            rows = self.codes[k].rows[found[hit]]
            if open_ is None:
                out[hit] = rows
                open_ = np.flatnonzero(~hit)
            else:
                out[open_[hit]] += rows
                open_ = open_[~hit]
            window = keys[~hit]
            if not len(open_):
                return out
            known = self.escapes[k].find(window >> np.uint64(8))
            out[open_[known >= 0]] += self.escapes[k].rows[known[known >= 0]]
        out[open_] += 8.0  # no context at all: one of 256 bytes
        return out


def fit(samples: dict[str, list[str]]) -> Model:
    """The frozen trees of the given texts by language."""
    languages = sorted(samples)
    if not languages:
        return Model([], [], [])
    data = {x: np.frombuffer(PAD + PAD.join(t.encode() for t in samples[x]), np.uint8) for x in languages}
    codes, escapes = [], []
    for k in range(ORDER + 1):
        counted = []
        for x in languages:
            window = np.zeros(max(len(data[x]) - k, 0), np.uint64)
            for j in range(k + 1):
                window = (window << np.uint64(8)) | data[x][j : len(data[x]) - k + j]
            counted.append(np.unique(window, return_counts=True))
        keys = np.unique(np.concatenate([c[0] for c in counted]))
        contexts = np.unique(keys >> np.uint64(8))
        cost = np.empty((len(keys), len(languages)), np.float32)
        escape = np.zeros((len(contexts), len(languages)), np.float32)
        lower = np.full((len(keys), len(languages)), 8.0, np.float32)
        if k:
            lower = codes[-1].rows[codes[-1].find(keys & np.uint64((1 << (8 * k)) - 1))]
        for j, (own, n) in enumerate(counted):
            context = np.searchsorted(contexts, own >> np.uint64(8))
            total = np.bincount(context, n, len(contexts))
            kinds = np.bincount(context, minlength=len(contexts))
            seen = kinds > 0
            escape[seen, j] = np.log2((total[seen] + kinds[seen]) / kinds[seen])
            cost[:, j] = lower[:, j] + escape[np.searchsorted(contexts, keys >> np.uint64(8)), j]
            cost[np.searchsorted(keys, own), j] = np.log2((total + kinds)[context] / n)
        codes.append(Table(keys, cost))
        escapes.append(Table(contexts, escape))
    return Model(languages, codes, escapes)


def sample(labelled: DataFrame, docs_a_language: int = DOCS_A_LANGUAGE, docs_in_all: int = DOCS_IN_ALL,
           least: int = LEAST_A_LANGUAGE, excerpt: int = EXCERPT) -> dict[str, list[str]]:
    """The training texts by label: a bounded sample of the labelled rows (doc_id, text, lang).

    Every label is learned. Of each the `docs_a_language` distinct texts with
    the least hash of id and text are taken, fewer where there are so many
    labels that they would exceed `docs_in_all`, but never under `least`. Of a
    text above `excerpt` characters a part of that length counts, from a place
    that its hash chooses. The driver holds no more than that.
    """
    usable = labelled.where(F.col("lang").isNotNull() & (F.length("text") >= 1))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    each = max(least, min(docs_a_language, docs_in_all // len(counts)))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, 1.5 * each / n)])
    begin = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - excerpt, F.lit(0)) + 1).cast("int") + 1
    drawn = usable.select("lang", F.substring("text", begin, F.lit(excerpt)).alias("text"), draw.alias("u")).where(F.col("u") < share[F.col("lang")])
    # repeated rows draw alike, so they fold before the cut, which acts in every task first
    best = Window.partitionBy("lang").orderBy("u", "text")
    found: dict[str, list[str]] = {}
    for r in drawn.distinct().withColumn("place", F.row_number().over(best)).where(F.col("place") <= each).orderBy("lang", "place").collect():
        found.setdefault(r["lang"], []).append(r["text"])
    return found


def scored(model: Model, batch_texts: list[str]) -> tuple[list[str], list[float], list[float]]:
    """Predicted language of each text, its posterior and the bits a byte takes under it."""
    best, score, cost = [UNKNOWN] * len(batch_texts), [0.0] * len(batch_texts), [0.0] * len(batch_texts)
    asked = [i for i, t in enumerate(batch_texts) if t and any(map(str.isalpha, t))] if model.languages else []
    begin = 0
    while begin < len(asked):
        end, size, parts = begin, 0, []
        while end < len(asked) and (end == begin or size < SCORED_AT_ONCE):
            parts.append(batch_texts[asked[end]].encode("utf-8", "replace"))
            size += len(parts[-1])
            end += 1
        if end - begin == 1:  # a long text: in blocks that overlap by the context
            data = np.frombuffer(PAD + parts[0], np.uint8)
            bits = [sum(model.lengths(data[at : at + SCORED_AT_ONCE + ORDER]).sum(0, dtype=np.float64) for at in range(0, len(data) - ORDER, SCORED_AT_ONCE))]
        else:
            data = np.frombuffer(PAD + PAD.join(parts), np.uint8)
            starts = np.cumsum([0] + [len(p) + ORDER for p in parts])[:-1]
            # the padding after a text belongs to no text
            lengths = model.lengths(data)
            stops = starts + [len(p) for p in parts]
            edges = np.stack([starts, stops], 1).ravel()
            edges = edges[:-1] if edges[-1] >= len(lengths) else edges
            bits = np.add.reduceat(lengths, edges, axis=0, dtype=np.float64)[::2]
        for i, row, part in zip(asked[begin:end], bits, parts):
            at = int(np.argmin(row))
            cost[i] = float(row[at]) / len(part)
            best[i] = model.languages[at]
            score[i] = float(1.0 / np.exp2(np.minimum(row[at] - row, 0)).sum())
        begin = end
    return best, score, cost


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """Adds lang_pred, score and bits (a byte) to the columns `keep` of `docs`, whose text is column `text`.

    * null text or text without a letter (empty too): `und`, score 0;
    * a model without languages (no labelled rows): every text is `und`;
    * a tie goes to the language first in order;
    * very long texts are scored whole, in blocks.
    """
    held = docs.sparkSession.sparkContext.broadcast(model.arrays())
    fields = [docs.schema[c] for c in keep]
    stamp = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = once(("language", stamp), lambda: Model.of(held.value))
        for batch in rebatched(batches, "text", 4 << 20):
            best, score, bits = scored(trees, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())],
                [*keep, "lang_pred", "score", "bits"],
            )

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.mapInArrow(run, f"{names}, lang_pred string, score double, bits double")


def held_out(doc_id: str = "doc_id"):
    """The fold that is never learned from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame) -> Model:
    """The model of the labelled documents outside the held-out fold; a null doc_id is never learned from."""
    return fit(sample(docs.select("doc_id", "text", "lang").where(~held_out())))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row of `docs` (doc_id, text, lang).

    Learned from the labelled rows of `docs` outside the held-out fold, and
    applied to all rows. A null doc_id has held_out false. Repeated rows are
    predicted alike; further columns are ignored; an empty table has no rows.
    """
    model = train(docs)
    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return predict(rows, model, "doc_id", "held_out").drop("bits")


def recognised(docs: DataFrame, least: float = 0.5, most: float = BITS_A_BYTE) -> DataFrame:
    """The documents whose language is recognised: not `und`, with a posterior of `least` or more, and explained by it.

    The posterior tells languages apart only; text of none of them, or no text
    at all, takes more than `most` bits a byte under each, at any length.
    """
    clash = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*[F.col(c).alias(clash[c]) for c in docs.columns], F.col("text"))
    known = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least) & (F.col("bits") <= most)
    kept = predict(inner, train(docs), *clash.values()).where(known)
    return kept.select(*[F.col(inside).alias(c) for c, inside in clash.items()])
