"""Stages where ids repeat or are missing, and identifiers of every character."""

import os
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodegraph.llm import exact_dedup, minhash_forest, mixing, packing

os.environ["TOKENIZERS_PARALLELISM"] = "false"
WORD = public_tokenizers.path("word_bpe_49k.json")


def left(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_one_row_of_each_text_stays(docs):
    rows = [(5, "a"), (5, "b"), (9, "a"), (7, "c"), (7, "c"), (7, "c"), (None, "a"), (None, "d"), (None, "d"), (1, None), (2, ""), (3, "é" * 9000), (3, "é" * 9000 + "x")]
    table = docs(rows)
    kept = exact_dedup.without_copies(table)
    assert kept.columns == table.columns
    assert left(kept) == Counter([(9, "a"), (5, "b"), (7, "c"), (None, "d"), (2, ""), (3, "é" * 9000), (3, "é" * 9000 + "x")])
    assert exact_dedup.without_copies(docs([])).collect() == []


def test_one_row_of_each_group_of_near_copies_stays(docs):
    rng = random.Random(41)
    base = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(200)) for _ in range(4)]
    rows = [(5, base[0]), (5, base[1]), (9, base[0] + " end"), (7, base[2]), (7, base[2]), (7, base[2] + " more"), (8, base[2] + " x"),
            (None, base[0]), (None, base[3]), (None, base[3]), (None, base[3] + " tail"), (11, ""), (11, ""), (None, None)]
    table = docs(rows)
    kept = minhash_forest.without_near_copies(table)
    assert kept.columns == table.columns
    found = left(kept)
    assert found[(5, base[0])] == found[(5, base[1])] == 1 and (9, base[0] + " end") not in found and (None, base[0]) not in found
    assert sum(n for (i, _), n in found.items() if i == 7) == 1 and not any(i == 8 for i, _ in found)
    assert sum(n for (i, t), n in found.items() if i is None and t) == 1
    assert found[(11, "")] == 2 and found[(None, None)] == 1


def test_rows_are_drawn_beside_their_text(docs):
    rng = random.Random(42)
    rows = [(rng.choice([None, i % 40]), " ".join(f"word{rng.randint(0, 9)}" for _ in range(20)), rng.choice(["en", None]), rng.choice("aab")) for i in range(200)]
    table = docs(rows + rows[:5])
    kept, drawn = mixing.mixed(table), mixing.sampled(table)
    assert kept.columns == table.columns
    # ids may repeat: rows of one id and cell share their draw
    want = Counter((r.doc_id, r.source, r.lang, r.topic) for r in drawn.where("kept").collect())
    got = Counter((r.doc_id, r.source, r.lang, r.topic) for r in mixing.described(kept).collect())
    assert got == want and 0 < sum(got.values()) < 205


def differing(encoder, library, texts):
    want = library.encode_batch(texts, add_special_tokens=False)
    return [t for t, own, w in zip(texts, encoder.ids(texts), want) if np.frombuffer(own, encoder.kind).tolist() != w.ids]


@pytest.mark.parametrize("frame", ["a{}b {}. X", "{}", "{}{}, A{}. B", "H{} {}A. it's{} 3{}4", "{}'s {}'T"])
def test_identifiers_of_every_character(frame):
    encoder, library = packing.Encoder(WORD), Tokenizer.from_file(WORD)
    points = [c for c in range(0x30000) if not 0xD800 <= c <= 0xDFFF]
    for i in range(0, len(points), 8000):
        assert differing(encoder, library, [frame.replace("{}", chr(c)) for c in points[i : i + 8000]]) == []


@pytest.mark.parametrize("seed", range(3))
def test_no_text_spoils_a_later_one(seed):
    encoder, library, rng = packing.Encoder(WORD), Tokenizer.from_file(WORD), random.Random(seed)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "hello", "Alpha", "the", "and", " ", "\n", "  ", "\t", ".", ",", "'s", "’s", "হয়", "बाज़",
             "H̱", "é", "é", "Σ", "İ", "ſ", "1", "日本", "　", "\x1c", "​", "K", "Å", "̀", "ǰ", "J̌"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(6000)]
    texts += ["hello<|endoftext|>", "alpha beta<|endoftext|>", "the alpha and the beta", "হয়, হয়.", "बाज़. next"]
    rng.shuffle(texts)
    for i in range(0, len(texts), 700):
        assert differing(encoder, library, texts[i : i + 700]) == []


def test_ids_of_any_type_are_packed(spark):
    rows = [("doc-1", "one two", "a"), (None, "three", "a"), ("doc-2", None, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id string, text string, source string"), WORD).collect()
    assert {p.doc_id for p in got} == {"doc-1", None, "doc-2"}
