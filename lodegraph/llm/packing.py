"""Mixture-controlled packing by deficit round-robin.

Every source is a queue of token identifiers. The sources are visited in
turn; each visit adds the source's quantum to its deficit and, once a packet's
worth has gathered, moves that many tokens from the head of the queue into the
running sequence, which is cut every `window` tokens. Deficits carry over from
window to window. Across partitions they carry by position: partition p of P
owns the part from p/P to (p+1)/P of every queue, so each partition holds the
mixture of the whole, and the fraction of a token by which the partition
before ran ahead is its starting deficit.

The tokens are made once and cross the network once. A long document is cut
where partitions meet; a large source is dealt over all partitions.
"""

from __future__ import annotations

import functools
import gc
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import once, rebatched
from lodegraph.session import cut_lineage

WINDOW, PACKET = 2048, 64
composed = functools.partial(unicodedata.is_normalized, "NFC")
TOKENS_A_PARTITION = 4_000_000
WORDS_REMEMBERED, PIECES_REMEMBERED = 150_000, 1_000_000
# rows of (source, block) totals, some 60 bytes each, up to which they are broadcast
BROADCAST_ROWS = 200_000


class Encoder:
    """Token identifiers of a text by a tokenizer file that ignores white space.

    Words between blanks do not influence each other under such a file, nor do
    a word's runs of letters, digits and signs, so every distinct one is
    encoded once by the library and remembered. A word is handed to the library
    whole where it might be cut otherwise there: where it is not in composed
    form, has characters of no known class, or may hold a special string.
    """

    # Fixed value: how word-end vocabularies of this family cut words into pieces.
    PIECES = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
    # letters and digits that are letters and digits to everyone; a stop after anything else is left where it is
    PLAIN = "0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03b1-\u03c1\u0410-\u044f\u4e00-\u9fa5 \n\r\t"

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.wide = self.library.get_vocab_size() > 1 << 16
        self.kind = "<u4" if self.wide else "<u2"
        self.signs = re.compile(rf"[^{self.PLAIN}][.,] ").search
        self.cut = regex.compile(self.PIECES).findall
        self.known: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}

    def encode(self, pieces: list[str]) -> list[bytes]:
        """Identifiers of each piece.

        Pieces go to the library as one text, a line each, and every identifier
        belongs to the piece in whose line it begins. Special strings take
        blanks around them along, so pieces that may hold one go alone.
        """
        found: dict[int, bytes] = {}
        alone = [i for i, p in enumerate(pieces) if "<|" in p or "\n" in p]
        for i, x in zip(alone, self.library.encode_batch([pieces[i] for i in alone], add_special_tokens=False) if alone else ()):
            found[i] = np.array(x.ids, self.kind).tobytes()
        lines = [i for i in range(len(pieces)) if i not in found]
        if lines:
            whole = self.library.encode("\n".join([pieces[i] for i in lines]), add_special_tokens=False)
            ids, width = np.array(whole.ids, self.kind), int(self.kind[2])
            starts = np.cumsum([0] + [len(pieces[i]) + 1 for i in lines])
            at = np.searchsorted(np.array([x[0] for x in whole.offsets], np.int64), starts) * width
            data = ids.tobytes()
            found.update(zip(lines, [data[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]))
        return [found[i] for i in range(len(pieces))]

    def spaced(self, text: str) -> str:
        """The text with stops and commas set apart and in lower case, where that changes no identifier.

        Both only make words alike sooner. A sign or a mark before the stop
        would belong to one run with it; a text that is not in composed form,
        before or after, keeps its case, as the library composes first.
        """
        text = text.replace("\n", " ")
        if "<|" not in text and "\u0130" not in text and "\u03a3" not in text:
            lower = text.lower()
            if text.isascii() or composed(text) and composed(lower):
                text = lower
            if not self.signs(text):
                text = text.replace(". ", " . ").replace(", ", " , ")
        return text

    def cut_up(self, word: str) -> list[str]:
        # (what is not printable includes what only some versions of Unicode assign)
        if not word.isascii() and ("'" in word or "\u0130" in word or not word.isprintable() or not composed(word)) or "<|" in word:
            return [word]
        if word[-1] in ".,;:!?" and word[:-1].isalpha():
            return [word[:-1], word[-1]]
        return self.cut(word)

    def ids(self, texts: list[str]) -> list[bytes]:
        known, pieces = self.known, self.pieces
        split = [self.spaced(t).split(" ") for t in texts]
        words = set().union(*split)
        new = words.difference(known)
        whole = {w for w in new if w.isalpha()}  # one piece, as most are
        parts = {w: self.cut_up(w) for w in new.difference(whole)}
        unseen = list(whole.union(*parts.values()).difference(pieces))
        here = dict(zip(unseen, self.encode(unseen))) if unseen else {}
        # early comers are the frequent ones, so what is full stays as it is
        if len(pieces) < PIECES_REMEMBERED:
            pieces.update(here)
        found = {w: known[w] for w in words.difference(new)}
        for w in whole:
            found[w] = here[w] if w in here else pieces[w]
        for w, own in parts.items():
            found[w] = b"".join([here[p] if p in here else pieces[p] for p in own])
        if len(known) < WORDS_REMEMBERED:
            known.update({w: found[w] for w in new})
        return [b"".join(map(found.__getitem__, own)) for own in split]


def tokenised(docs: DataFrame, path: str, end: int) -> DataFrame:
    """Rows (doc_id, source, ids, n, block, place): place counts the tokens of
    the source before the row within its block, the task that made it."""
    rows = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"),
        F.coalesce("text", F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, places, block = once(("encoder", path), lambda: Encoder(path)), {}, TaskContext.get().partitionId()
        last, width = (end.to_bytes(4, "little"), 4) if encoder.wide else (end.to_bytes(2, "little"), 2)
        for batch in rebatched(batches, "text", 4 << 20):
            gc.disable()  # millions of short-lived strings and no cycles
            ids = [x + last for x in encoder.ids(batch.column("text").to_pylist())]
            gc.enable()
            sizes, place = [len(x) // width for x in ids], []
            for source, n in zip(batch.column("source").to_pylist(), sizes):
                place.append(places.get(source, 0))
                places[source] = place[-1] + n
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array([width] * len(ids), pa.int32()), pa.array([block] * len(ids), pa.int32()), pa.array(place, pa.int64())],
                ["doc_id", "source", "ids", "n", "width", "block", "place"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, source string, ids binary, n long, width int, block int, place long")


def round_robin(queues: list[int], quanta: list[float], deficits: list[float], packet: int = PACKET) -> Iterator[tuple[int, int]]:
    """Yields (queue, tokens) until all queues are empty."""
    left, deficits = list(queues), list(deficits)
    open_ = [i for i, n in enumerate(left) if n]
    while open_:
        rounds = 1
        if len(open_) > 1 or deficits[open_[0]] + quanta[open_[0]] < packet:  # skip rounds in which nobody can be served
            waits = min((min(packet, left[i]) - deficits[i]) / quanta[i] for i in open_)
            rounds = max(1, int(np.ceil(waits)))
        for i in open_:
            deficits[i] += rounds * quanta[i]
            if deficits[i] >= min(packet, left[i]):
                n = min(int(deficits[i]), left[i])
                left[i] -= n
                deficits[i] -= n
                yield i, n
        open_ = [i for i in open_ if left[i]]


def windows(total: int, window: int) -> Iterator[int]:
    """Sequence lengths: full windows, then the rest as powers of two, so nothing is padded."""
    for _ in range(total // window):
        yield window
    rest = total % window
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            yield 1 << bit


def pack(
    docs: DataFrame,
    path: str,
    end: int = 1,
    window: int = WINDOW,
    packet: int = PACKET,
    weights: dict[str, float] | None = None,
    tokens_a_partition: int = TOKENS_A_PARTITION,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    A document is its identifiers under the tokenizer file `path` followed by
    `end`. Without `weights` the target proportions are the sources' shares of
    all tokens, so every window keeps to them until the end; with `weights`
    (by source; others count 1) the mixture holds until a source runs out.
    Sequences hold `window` tokens; the rest of each partition is laid out in
    sequences whose lengths are powers of two, which need no padding.

    * null or empty text: a piece of the single identifier `end`;
    * null source: a source of its own; null doc_id and repeated rows: packed
      each, like any document;
    * very long texts: cut over windows and, if need be, partitions;
    * empty table: no rows; further columns are ignored.
    """
    rows = cut_lineage(tokenised(docs, path, end))
    blocks = rows.groupBy("source", "block").agg(F.sum("n").alias("n"))
    order = "PARTITION BY source ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    placed = cut_lineage(blocks.select(
        "source", "block", F.expr(f"coalesce(sum(n) OVER ({order}), 0)").alias("before"),
        F.expr("sum(n) OVER (PARTITION BY source)").alias("all_of_source"),
    ))
    if placed.count() <= BROADCAST_ROWS:  # beyond that an ordinary join
        placed = F.broadcast(placed)
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // tokens_a_partition))
    # partition p owns [ceil(T p / P), ceil(T (p + 1) / P)) of a queue of T tokens
    edge = lambda p: f"((all_of_source * ({p}) + {parts - 1}) DIV {parts})"
    ranged = (
        rows.withColumnRenamed("source", "s").withColumnRenamed("block", "k")
        .join(placed, F.expr("s <=> source AND k = block"))
        .withColumn("at", F.col("before") + F.col("place"))
        .withColumn("part", F.expr(f"explode(sequence((at * {parts}) DIV all_of_source, ((at + n - 1) * {parts}) DIV all_of_source))"))
        .withColumn("from", F.expr(f"greatest(at, {edge('part')})"))
        .withColumn("to", F.expr(f"least(at + n, {edge('part + 1')})"))
        .select(
            "part", "source", "all_of_source", "from", "doc_id", F.expr("`from` - at").alias("start"),
            F.col("n").alias("doc_tokens"), "width",
            F.expr("substring(ids, cast((`from` - at) * width + 1 AS int), cast((`to` - `from`) * width AS int))").alias("ids"),
        )
    )
    weights = dict(weights or {})

    def run(key, group):
        part = key[0].as_py()
        group = group.sort_by([("source", "ascending"), ("from", "ascending")])
        source, ids, width = group.column("source").to_pylist(), group.column("ids").to_pylist(), group.column("width")[0].as_py()
        totals = group.column("all_of_source").to_pylist()
        doc, start, doc_tokens = (group.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens"))
        names = sorted({*source}, key=lambda s: (s is None, s or ""))
        rows_of: dict = {s: [] for s in names}
        for i, s in enumerate(source):
            rows_of[s].append(i)
        words = [np.frombuffer(x, "<u4" if width == 4 else "<u2").astype("<u4").tobytes() for x in ids]
        sizes = [len(w) // 4 for w in words]
        queues = [sum(sizes[i] for i in rows_of[s]) for s in names]
        whole = [totals[rows_of[s][0]] for s in names]
        want = [weights.get(s, 1.0) if weights else float(t) for s, t in zip(names, whole)]
        quanta = [window * w / sum(want) for w in want]
        # the fraction of a token by which the partition before ran ahead of each queue's share
        deficits = [-((-t * part) % parts) / parts for t in whole]
        heads = [[0, 0] for _ in names]  # row of the queue, tokens taken from it
        room = windows(sum(sizes), window)
        sequence, offset, free = -1, 0, 0
        out: list[list] = [[] for _ in range(8)]
        for q, n in round_robin(queues, quanta, deficits, packet):
            own, head = rows_of[names[q]], heads[q]
            while n:
                if not free:
                    sequence, offset, free = sequence + 1, 0, next(room)
                i = own[head[0]]
                take = min(n, free, sizes[i] - head[1])
                at = start[i] + head[1]
                if out[0] and out[7][-1] == i and out[5][-1] == sequence and out[1][-1] + out[2][-1] == at and out[6][-1] + out[2][-1] == offset:
                    out[2][-1] += take  # the piece goes on
                else:
                    for column, value in zip(out, (doc[i], at, take, 0, doc_tokens[i], sequence, offset, i)):
                        column.append(value)
                head[1] += take
                if head[1] == sizes[i]:
                    head[0], head[1] = head[0] + 1, 0
                n, free, offset = n - take, free - take, offset + take
        for k, (i, at, n) in enumerate(zip(out[7], out[1], out[2])):
            own = 4 * (at - start[i])
            out[3][k] = zlib.crc32(memoryview(words[i])[own : own + 4 * n])
        out[5] = [(part << 32) + s for s in out[5]]
        out[7] = [source[i] for i in out[7]]
        kinds = [group.schema.field("doc_id").type] + [pa.int64()] * 6 + [pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # as many tasks as parts, so that what a task reads does not grow with the input
    return ranged.repartition(parts, "part").groupBy("part").applyInArrow(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
    )
