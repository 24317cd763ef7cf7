"""Exact, near and line dedup, against plain versions on small fixtures."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodegraph.llm import common, exact_dedup, line_dedup, minhash_forest

WORDS = [a + b + c for a in "bdfg" for b in "aeio" for c in "klmn"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split(" "))


# --- exact -----------------------------------------------------------------


def exact_rows():
    rng = random.Random(1)
    long = [prose(rng, 6000) for _ in range(3)]
    rows = [(1, None), (2, ""), (3, " "), (4, "a"), (5, "a"), (6, "A"), (7, "a "), (8, "a"), (8, "a"), (None, "a"), (None, "alone")]
    for i, t in enumerate(long * 3):
        rows.append((100 + i, t))
    rows += [(200, long[0] + "x"), (201, "y" + long[0]), (202, long[0][:-1]), (203, "😀é" * 3000), (204, "😀é" * 3000)]
    return rows


@pytest.mark.parametrize("identify", [F.xxhash64, lambda c: F.length(c).cast("long"), lambda c: F.lit(1).cast("long")])
def test_exact_groups_equal_plain_grouping(docs, identify):
    rows = exact_rows()
    want = []
    for doc_id, text in rows:
        same = [i for i, t in rows if (t or "") == (text or "")]
        keep = max((i for i in same if i is not None), default=None)
        digest = hashlib.sha256((text or "").encode()).hexdigest()
        want.append((doc_id, keep, len(same), doc_id is not None and doc_id == keep, digest))
    got = sorted(exact_dedup.groups(docs(rows), identify=identify, shortest=50, longest=300).collect(), key=str)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_chunks_make_up_the_text_and_follow_its_content(docs):
    rng = random.Random(2)
    text = prose(rng, 3000)
    moved = "zz " + text
    rows = docs([(1, text), (2, moved), (3, ""), (4, "x" * 10_000), (5, "a\r\n b 😀")]).select(
        "doc_id", "text", exact_dedup.chunked(F.col("text")).alias("chunks")
    ).collect()
    for r in rows:
        assert "".join(r.chunks) == r.text and all(len(c) <= exact_dedup.LONGEST for c in r.chunks)
    first, second = (set(r.chunks) for r in rows[:2])
    assert len(first & second) > len(first) / 2


def test_exact_empty_table(docs):
    assert exact_dedup.groups(docs([])).collect() == []


def test_without_copies_keeps_columns(docs):
    table = docs([(1, "a"), (2, "a"), (3, "b"), (None, "a")])
    kept = exact_dedup.without_copies(table)
    assert kept.columns == table.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 3, None]


# --- near ------------------------------------------------------------------


def plain_near(rows, words):
    sets = []
    for _, text in rows:
        own = (text or "").encode().lower().split()
        k = min(words, len(own))
        sets.append({tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common_ = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common_ >= 80 * (len(sets[i]) + len(sets[j]) - common_):
                up[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        component = doc_id if not sets[i] else min(ids, default=None)
        out.append((doc_id, len(sets[i]), component, not sets[i] or (doc_id is not None and doc_id == component)))
    return out


def near_rows():
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE  two"), (8, "two one"), (None, "one two"), (9, "É x"), (10, "é x")]
    base = prose(rng, 120)
    rows += [(100 + i, edited(rng, base, 0.05)) for i in range(60)]
    rows += [(200 + i, edited(rng, base, 0.3)) for i in range(10)]
    for g in range(8):
        own = prose(rng, rng.choice([5, 20, 80, 300]))
        rows += [(300 + 10 * g + i, edited(rng, own, 0.04 * i)) for i in range(5)]
    chain = prose(rng, 100).split(" ")
    rows += [(500 - i, " ".join(chain[5 * i :] + [rng.choice(WORDS) for _ in range(5 * i)])) for i in range(8)]
    rows += [(600, base), (601, base), (601, base), (700, prose(rng, 20_000))]
    return rows


@pytest.mark.parametrize("tile", [512, 8])
def test_near_copies_equal_all_pairs(docs, monkeypatch, tile):
    monkeypatch.setattr(minhash_forest, "TILE", tile)
    rows = near_rows()
    got = minhash_forest.near_copies(docs(rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_near(rows, 2)))


def test_near_stage_with_five_words(docs):
    rows = near_rows()
    table = docs(rows)
    kept = minhash_forest.without_near_copies(table)
    want = [r[0] for r in plain_near(rows, 5) if r[3] or r[0] is None]
    assert kept.columns == table.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, want))


def test_near_empty_table(docs):
    assert minhash_forest.near_copies(docs([])).collect() == []


def test_dense_regions_go_deeper(docs, monkeypatch):
    monkeypatch.setattr(minhash_forest, "DENSE", 3)
    rows = near_rows()
    got = minhash_forest.near_copies(docs(rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_near(rows, 2)))


# --- components ------------------------------------------------------------


def test_components_of_chains_stars_and_cycles(spark):
    chain = [(i, i + 1) for i in range(1, 200)]
    star = [(1000, 1001 + i) for i in range(300)]
    cycle = [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)]
    odd = [(5, 5), (None, 3), (9, None)]
    rows = spark.createDataFrame(chain + star + cycle + odd, "a long, b long")
    got = dict(map(tuple, common.components(rows).collect()))
    assert {got[i] for i in range(1, 201)} == {1} and {got[i] for i in range(1000, 1301)} == {1000} and {got[i] for i in range(2000, 2050)} == {2000}
    assert len(got) == 200 + 301 + 50
    assert common.components(rows.where("a < 0")).collect() == []


# --- lines -----------------------------------------------------------------


def plain_lines(rows, run, long_line):
    first, out = {}, []
    windows = []
    for doc_id, text in sorted({r for r in rows if r[0] is not None}):
        lines = (text or "").split("\n")
        for n in {run, 1}:
            for at in range(len(lines) - n + 1):
                key = (n, tuple(lines[at : at + n]))
                if n == run or len(lines[at].split()) >= long_line:
                    windows.append((doc_id, text, at, n, key))
    for w in sorted(windows, key=lambda w: (w[0], w[2])):
        first.setdefault(w[4], w)
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        gone = {at + k for d, t, at, n, key in windows if (d, t) == (doc_id, text) and first[key][:3] != (d, t, at) for k in range(n)}
        out.append((doc_id, len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


@pytest.mark.parametrize("run", [1, 2, 3])
def test_line_dedup_equals_plain_version(docs, run):
    rng = random.Random(run)
    pool = ["", "a", "b", "c", "d e", " ".join(["w"] * 60), " ".join(["v"] * 49)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    shared = "\n".join(f"line {i}" for i in range(20))
    rows += [(100, shared), (101, "x\n" + shared + "\ny"), (102, shared[:60]), (103, None), (104, ""), (105, "a\n" * 50), (106, "\n".join(map(str, range(5000))))]
    rows += [(None, shared), (107, "q\nr\ns\nt"), (107, "q\nr\ns\nt")]
    got = line_dedup.line_dedup(docs(rows), run=run).collect()
    want = plain_lines(rows, run, line_dedup.LONG_LINE)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_line_dedup_empty_table(docs):
    assert line_dedup.line_dedup(docs([])).collect() == []
