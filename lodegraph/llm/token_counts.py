"""Token counts by byte-pair merging with a heap and a linked list.

Every pretoken starts as its bytes' symbols in a linked list; the adjacent
pair of lowest rank is popped from a heap again and again, merged, and its new
neighbours pushed. A text's count is the number of initial symbols minus the
number of merges, summed over its pretokens; no token identifiers are made.
Stretches of text that stand between single blanks tokenise independently, so
each task counts every distinct stretch once and remembers it.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import once, rebatched, texts

# Fixed value: how byte-level vocabularies of this family cut text into pretokens.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 800_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next unused one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Counter:
    """Counts tokens under the merges of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.symbols = byte_symbols()
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.cut = regex.compile(PRETOKEN)
        self.blanks = re.compile(r"\s[^\S\n]|[^\S \n]|\s\n|^\s|\s$")
        self.known: dict[str, int] = {}
        self.pretokens: dict[str, int] = {}

    def pretoken(self, piece: str) -> int:
        """Tokens of a pretoken; short ones are remembered too."""
        n = self.pretokens.get(piece)
        if n is None:
            n = self.merged(piece)
            if len(piece) <= 64 and len(self.pretokens) < REMEMBERED:
                self.pretokens[piece] = n
        return n

    def merged(self, pretoken: str) -> int:
        """Initial symbols minus merges of one pretoken."""
        parts = [self.symbols[b] for b in pretoken.encode("utf-8", "replace")]
        n, ranks = len(parts), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, parts[i], parts[i + 1]) for i in range(n - 1) if (rank := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if parts[i] == left else n
            if j >= n or parts[j] != right:
                continue  # one of the two was merged meanwhile
            parts[i], parts[j] = left + right, ""
            after[i] = k = after[j]
            count -= 1
            if k < n:
                before[k] = i
                if (rank := ranks.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (rank, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (rank := ranks.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (rank, h, parts[h], parts[i]))
        return count

    def stretch(self, text: str) -> int:
        if not self.special or not self.special.search(text):
            return sum(map(self.pretoken, self.cut.findall(text)))
        total = 0
        for piece in self.special.split(text):
            if self.special.fullmatch(piece):
                total += 1
            else:
                total += sum(map(self.pretoken, self.cut.findall(piece)))
        return total

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        if self.blanks.search(text):  # cut only before a single blank or line break between other characters
            head, *rest = re.split(r"(?<=\S)(?=[ \n]\S)", text)
            rest = [r if r[0] == "\n" else r[1:] for r in rest]
        else:
            head, *rest = text.replace("\n", " \n").split(" ")
        known, total = self.known, self.stretch(head)
        for r in rest:
            if (n := known.get(r)) is None:
                n = self.stretch(r if r[0] == "\n" else " " + r)
                if len(known) < REMEMBERED:  # early comers are the frequent ones
                    known[r] = n
            total += n
        return total


def token_counts(docs: DataFrame, path: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) per row of `docs`.

    `path` is a byte-level tokenizer file that every executor can open.

    * null or empty text: no bytes, no tokens;
    * null ids and repeated rows: kept, a row each;
    * very long texts: counted whole, n log n in their longest pretoken;
    * special strings of the file inside a text count one token each;
    * empty table: no rows; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once(("tokens", path), lambda: Counter(path))
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array([counter.count(t) for t in batch.column("text").to_pylist()], pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    rows = texts(docs, doc_id=doc_id, text=text).select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(lambda it: run(rebatched(it, "text", 8 << 20)), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
