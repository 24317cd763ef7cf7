"""Vector links and mixing, against plain versions."""

import hashlib
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodegraph.llm import mixing, vector_graph

VECTORS = "vec_id long, embedding array<float>, label int, node string, shard int"


def vectors(rng):
    rows, rand = [], np.random.default_rng(12)
    for i in range(400):
        rows.append((i, rand.normal(size=16)))
    for g in range(12):
        base = rand.normal(size=16)
        base /= np.linalg.norm(base)
        rows += [(1000 + 100 * g + k, 3 * (base + rand.normal(size=16) * 0.04)) for k in range(rng.choice([2, 5, 40]))]
    rows += [(3000 + k, rows[0][1]) for k in range(5)] + [(None, rows[1][1]), (5000, rows[2][1] * 1e-20), (5001, rows[3][1] * 1e30)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    return rows + [
        (4000, None), (4001, []), (4002, [0.0] * 16), (4003, [float("nan")] + [1.0] * 15), (4004, [float("inf")] + [1.0] * 15), (4005, [None] + [1.0] * 15),
        (4006, rows[5][1] + [0.0, 0.0]), (4007, rows[6][1][:15]), (0, rows[0][1]),
    ]


def plain_vectors(rows, cosine=0.95):
    width = max(len(v or []) for _, v in rows)
    unit = np.zeros((len(rows), width))
    usable = np.zeros(len(rows), bool)
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            unit[i, : len(v)] = np.array(v) / np.abs(v).max()
            unit[i] /= np.linalg.norm(unit[i])
            usable[i] = True
    near = (unit @ unit.T >= cosine) & usable[:, None] & usable[None, :]
    np.fill_diagonal(near, False)
    label = np.arange(len(rows))
    while True:
        new = label.copy()
        i, j = np.nonzero(near)
        np.minimum.at(new, i, label[j])
        if (new == label).all():
            break
        label = new
    out = []
    for i, (vec_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        component = vec_id if not usable[i] else min(ids, default=None)
        out.append((vec_id, int(near[i].sum()), component, not usable[i] or (vec_id is not None and vec_id == component)))
    return out


@pytest.mark.parametrize("shard, split", [(1000, 2048), (60, 2048), (60, 20)])
def test_vector_links_equal_all_pairs(spark, monkeypatch, shard, split):
    monkeypatch.setattr(vector_graph, "SHARD", shard)
    monkeypatch.setattr(vector_graph, "SPLIT", split)
    rows = vectors(random.Random(13))
    table = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VECTORS)
    got = sorted(map(repr, map(tuple, vector_graph.near_vectors(table).collect())))
    want = sorted(map(repr, plain_vectors(rows)))
    found = sum(a == b for a, b in zip(got, want))
    assert len(got) == len(want)
    links = sum(r[1] for r in plain_vectors(rows))
    counted = sum(r.n_links for r in vector_graph.near_vectors(table).collect())
    assert counted <= links and counted >= 0.98 * links and found >= 0.95 * len(want)


def test_vector_tables_without_links(spark):
    assert vector_graph.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    only = spark.createDataFrame([(1, None, 1, "x", 2), (2, [1.0, 0.0], 1, "x", 2)], VECTORS)
    assert sorted(map(tuple, vector_graph.near_vectors(only).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_audit_sees_lost_links(spark):
    rows = [(i, [1.0, 0.001 * i]) for i in range(50)]
    table = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VECTORS)
    _, nodes = vector_graph.classes(table.selectExpr("vec_id", "cast(embedding as array<double>) as e"))
    full, half = (nodes.selectExpr("node", f"cast({n} as bigint) as links") for n in (49, 24))
    assert vector_graph.audit(nodes, full) == 1.0 and 0.4 < vector_graph.audit(nodes, half) < 0.55


# --- mixing ----------------------------------------------------------------


def mixing_rows():
    rng = random.Random(14)
    rows = []
    for i in range(600):
        source = rng.choice(["big"] * 6 + ["mid"] * 3 + ["small", None])
        rows.append((i, " ".join(rng.choice(["alpha", "beta", "gamma", "is", "no"]) for _ in range(rng.randint(1, 60))), rng.choice(["en", "en", "de", None]), source))
    return rows + [(1000, None, "en", "big"), (1001, "", "xx", "empty"), (None, "alpha beta", "en", "big"), (1002, "word " * 50_000, "en", "long"), (5, "alpha", "en", "big")]


def plain_cells(rows):
    def topic(text):
        lead = next((w for w in (text or "").split() if len(w) >= 4), "")
        return f"t{int(hashlib.md5(lead.lower().encode()).hexdigest()[:6], 16) % mixing.TOPICS}"

    keys = [(s, lang, topic(t)) for _, t, lang, s in rows]
    tokens = [len((t or "").split()) for _, t, _, _ in rows]
    cells = {}
    for k, n in zip(keys, tokens):
        cells[k] = cells.get(k, 0) + n
    return keys, tokens, {k: n for k, n in cells.items() if n}


def filled(wanted, bounds, total):
    """`wanted` scaled to `total` within `bounds`: the factor found by halving an interval."""
    if sum(bounds.values()) <= total * (1 + 1e-12):
        return dict(bounds)
    low, high = 0.0, 1.0
    while sum(min(bounds[k], high * w) for k, w in wanted.items()) < total:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(bounds[k], mid * w) for k, w in wanted.items()) < total else (low, mid)
    return {k: min(bounds[k], high * w) for k, w in wanted.items()}


def test_sampling_equals_plain_fitting(docs):
    rows = mixing_rows()
    keys, tokens, cells = plain_cells(rows)
    whole = sum(cells.values())
    bounds = {k: n / (mixing.BUDGET * whole) for k, n in cells.items()}
    goals = []
    for d, name in enumerate(mixing.DIMENSIONS):
        own, held = Counter(), Counter()
        for k, n in cells.items():
            own[k[d]] += n
            held[k[d]] += bounds[k]
        goals.append(filled({v: n ** mixing.POWERS[name] for v, n in own.items()}, held, 1.0))
    weight = {k: float(n) for k, n in cells.items()}
    for _ in range(mixing.SWEEPS):
        for d in range(3):
            for v, goal in goals[d].items():
                weight |= filled({k: w for k, w in weight.items() if k[d] == v}, {k: b for k, b in bounds.items() if k[d] == v}, goal)
    want = []
    for (doc_id, *_), k, n in zip(rows, keys, tokens):
        p = min(1.0, mixing.BUDGET * weight[k] * whole / cells[k]) if k in cells else mixing.BUDGET
        u = int(hashlib.md5(str("" if doc_id is None else doc_id).encode()).hexdigest()[:13], 16) / 2**52
        want.append((doc_id, *k, n, round(p, 8), u < p))
    got = [(r.doc_id, r.source, r.lang, r.topic, r.n_tokens, round(r.probability, 8), r.kept) for r in mixing.sampled(docs(rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    kept = mixing.mixed(docs(rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(w[0]) for w in want if w[-1])
    assert kept.columns == docs(rows).columns


def test_marginals_meet_their_targets(docs):
    rows = mixing.described(docs([r for r in mixing_rows() if r[3] in ("big", "mid", "small")]))
    fitted = mixing.raked(mixing.cells(rows), targets={"source": {"small": 0.5, "big": 0.3}}, sweeps=20)
    shares = {(r.dimension, r.value): (r.share, r.goal) for r in mixing.marginals(fitted).collect()}
    assert abs(shares[("source", "small")][0] - 0.5) < 1e-3 and abs(shares[("source", "mid")][0] - 0.2) < 1e-3
    assert all(abs(share - goal) < 1e-3 for share, goal in shares.values())


def test_what_cannot_be_met_goes_to_the_others(docs):
    """A hot source, two small ones wanted for far more than they hold: the budget is spent all the same."""
    rows = [(i, "alpha beta gamma delta", ("en", "de")[i % 2], "hot" if i >= 90 else "mid" if i >= 10 else "small") for i in range(3000)]
    targets = {"source": {"small": 0.3, "mid": 0.3}}
    cells = mixing.cells(mixing.described(docs(rows)))
    shares = {r.value: r for r in mixing.marginals(mixing.raked(cells, targets, budget=0.5)).collect() if r.dimension == "source"}
    assert [round(shares[v].wanted, 9) for v in ("small", "mid", "hot")] == [0.3, 0.3, 0.4]
    for value, held in (("small", 10 / 1500), ("mid", 80 / 1500), ("hot", 1410 / 1500)):
        assert abs(shares[value].share - held) < 1e-9 and abs(shares[value].goal - held) < 1e-9
    chances = {r.source: r.probability for r in mixing.sampled(docs(rows), targets=targets).collect()}
    assert chances["small"] == chances["mid"] == 1.0 and abs(chances["hot"] - 1410 / 2910) < 1e-9
    none = mixing.sampled(docs(rows), targets={"source": {"small": 0.0}}).collect()
    assert not any(r.kept for r in none if r.source == "small") and any(r.kept for r in none if r.source == "hot")


def test_mixing_empty_table(docs):
    assert mixing.sampled(docs([])).collect() == []


def test_topics_of_whole_texts(docs):
    """Every word votes: texts that begin alike differ by what follows, however far behind."""

    def plain(text):
        classes = [int(hashlib.md5(w.lower().encode()).hexdigest()[:6], 16) % mixing.TOPICS for w in (text or "").split() if len(w) >= 4] or [
            int(hashlib.md5(b"").hexdigest()[:6], 16) % mixing.TOPICS]
        return f"t{max(classes, key=lambda c: (classes.count(c), -classes.index(c)))}"

    rng = random.Random(15)
    rows = [(i, "lead " + " ".join(rng.choice(["Alpha", "beta", "gamma", "délta", "is", "no"]) for _ in range(rng.randint(0, 40))), "en", rng.choice("ab")) for i in range(300)]
    rows += [(500, None, "en", "a"), (501, "", "en", "a"), (502, "is no", "en", "a"), (503, "lead " + "alpha " * 20_000 + "gamma " * 20_001, "en", "a"), (None, "beta alpha", "en", "b")]
    topic = mixing.topic_of_words(F.col("text"))
    got = mixing.sampled(docs(rows), topic=topic).collect()
    assert sorted((str(r.doc_id), r.topic) for r in got) == sorted((str(i), plain(t)) for i, t, *_ in rows)
    assert len({r.topic for r in got if r.doc_id is not None and r.doc_id < 300}) > 2
    kept = mixing.mixed(docs(rows), topic=topic)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)


def test_a_shard_of_near_copies_is_searched_in_bounded_memory():
    """Every member is in range of every vector asked, and has a long list; what is looked at at once stays small."""
    rng = np.random.default_rng(16)
    data = 1.0 + rng.normal(size=(1200, 16)) * 0.01
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    names = [f"{i:04d}" for i in range(len(data))]
    near = [[names[(i + k) % len(names)] for k in range(1, 201)] for i in range(len(names))]
    run = pa.table({"node": names, "v": pa.array([x.tobytes() for x in data], pa.binary()), "rank": [0] * len(names), "weight": [1] * len(names), "near": near})
    shard = vector_graph.Shard(run)
    tracemalloc.start()
    found = shard.in_range(data[:256].astype(np.float32), 0.95)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.all() and most < 100 << 20
