"""Host rules, clustering over a VA-file and source divergence, against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from lodegraph.llm import divergence, host_rules, va_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# --- host rules --------------------------------------------------------------


def plain_measures(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)), len(lines)


def plain_hosts(rows):
    """Largest shrunk rate and its rule by host."""
    tests = [lambda m, n: m[0] < 20, lambda m, n: 100 * m[4] > 30 * m[0], lambda m, n: 10 * m[2] > m[0], lambda m, n: 10 * m[3] > 3 * n]
    tests.append(lambda m, n: any(t(m, n) for t in tests[:4]))
    by_host = {}
    for _, text, _, host in rows:
        if host is not None:
            by_host.setdefault(host, []).append([t(*plain_measures(text)) for t in tests])
    sizes, out = {h: len(r) for h, r in by_host.items()}, {}
    total = sum(sizes.values())
    for k, rule in enumerate(("short", "repeated", "symbols", "lines", "total")):
        failed = {h: sum(r[k] for r in own) for h, own in by_host.items()}
        p = sum(failed.values()) / total
        spread = sum(sizes[h] * (failed[h] / sizes[h] - p) ** 2 for h in sizes)
        room = total - sum(n * n for n in sizes.values()) / total - (len(sizes) - 1)
        rho = (spread / (p * (1 - p)) - (len(sizes) - 1)) / room if 0 < p < 1 and room > 0 else 0
        strength = min(max(1 / rho - 1, 1), 10_000) if rho > 0 else 10_000
        for h in sizes:
            out.setdefault(h, []).append((round((failed[h] + p * strength) / (sizes[h] + strength), 6), -k, rule))
    return {h: max(own) for h, own in out.items()}


def host_rows():
    rng = random.Random(21)
    vocabulary = [f"wörd{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = []
    for i in range(300):  # a third of all rows are of one host
        host = "hot" if i % 3 == 0 else f"h{i % 17}" if i % 7 else "spam"
        text = prose(rng.randint(20, 60))
        if host == "spam" and rng.random() < 0.9:
            text = f"{text} " * 3 if rng.random() < 0.5 else prose(4)
        elif rng.random() < 0.1:
            text = rng.choice([prose(5), "buy # now\n" * 30, f"{text} {text}", f"line a b\nline a b\n {text}"])
        rows.append((i, text, "en", host))
    rows += [(1000, None, "en", "hot"), (1001, "", "en", None), (1002, prose(30), "en", None), (None, prose(30), "en", "hot"), (None, prose(30), "en", "spam"),
             (5, prose(40), "en", "lone"), (5, prose(40), "en", "spam"), (1003, " \n\t\n ", "en", "blank"), (1004, "日本語 テキスト " * 20_000, "ja", "ja"),
             (1005, "a\x1cb \x85 c　d\n" + prose(25), "en", "odd"), (1006, "x " * 8 + "x", "en", "odd")]
    return rows + rows[3:5]


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_host_rules_equal_the_plain_version(docs, monkeypatch, broadcast):
    monkeypatch.setattr(host_rules, "BROADCAST_HOSTS", broadcast)
    monkeypatch.setattr(host_rules, "HOT_SHARE", 5)
    rows = host_rows()
    hosts = plain_hosts(rows)
    assert hosts["spam"][0] > 0.5 and all(rate <= 0.5 for h, (rate, *_) in hosts.items() if h != "spam")
    want = []
    for doc_id, text, _, host in rows:
        m, _ = plain_measures(text)
        base = m[0] < 20 or 100 * m[4] > 30 * m[0]
        rate, _, rule = hosts.get(host, (None, 0, None))
        want.append((doc_id, *m, base, not base and not (rate or 0) > 0.5, host, rate, rule))
    got = [tuple(r) for r in host_rules.document_rules(docs(rows)).collect()]
    key = lambda r: repr((r[:9], r[10]))
    assert sorted(map(key, got)) == sorted(map(key, want))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[9] == b[9] or abs(a[9] - b[9]) < 2e-6
    # a sound document of a bad host goes, one of a sound host stays
    assert any(not r[6] and not r[7] and r[8] == "spam" for r in want) and any(r[7] for r in want if r[8] == "hot")


def test_rows_kept_by_their_own_text(docs):
    rows = host_rows()
    table = docs(rows)
    kept = host_rules.kept_documents(table)
    assert kept.columns == table.columns
    judged = Counter((r.doc_id, r.host) for r in host_rules.document_rules(table).where("kept").collect())
    assert Counter((r.doc_id, r.source) for r in kept.collect()) == judged


def test_hosts_of_urls_and_an_empty_table(docs, spark):
    from pyspark.sql import functions as F

    assert host_rules.document_rules(docs([])).collect() == []
    pages = spark.createDataFrame([(1, "http://a.org/x", "w " * 5), (2, "http://a.org/y", "w " * 5), (3, "no url", "w")], "page_id long, url string, html string")
    got = host_rules.document_rules(pages, F.try_parse_url("url", F.lit("HOST")), "page_id", "html").collect()
    assert {r.doc_id: r.host for r in got} == {1: "a.org", 2: "a.org", 3: None}


# --- VA-file -----------------------------------------------------------------


def plain_clusters(rows, dims, k, rounds, seed=3):
    rows = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    usable = [(i, [math.floor(1024 * Fraction(x)) for x in map(float, v)]) for i, v in rows]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in usable if i is not None)
    centroids = [x for _, x in order[:k]]
    square = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    assign = lambda: [min((square(x, c), j) for j, c in enumerate(centroids)) for _, x in usable]
    if not centroids:
        return []
    for _ in range(rounds):
        at = [j for _, j in assign()]
        for j in range(len(centroids)):
            own = [x for (_, x), a in zip(usable, at) if a == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    ends = assign()
    inertia, digests = Counter(), [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    for d, j in ends:
        inertia[j] += d
    fits = lambda x: x if x < 1 << 63 else None
    whole = lambda own: None if any(fits(d) is None for d in own) else fits(sum(own))
    per = {j: whole([d for d, a in ends if a == j]) for j in inertia}
    everything = whole([d for d, _ in ends])
    return [(i, j, fits(d), per[j], everything, digests[j]) for (i, _), (d, j) in zip(usable, ends)]


def vector_rows(dims=8, groups=6, n=400):
    rng = np.random.default_rng(22)
    centres = rng.normal(size=(groups, dims))
    rows = [(i, (centres[i % groups] + rng.normal(size=dims) * 0.1).tolist()) for i in range(n)]
    rows += [(1000, None), (1001, [None] + [1.0] * (dims - 1)), (1002, [float("nan")] * dims), (1003, [float("inf")] * dims), (1004, [1.0] * (dims - 1)),
             (1005, [1.0] * (dims + 1)), (1006, []), (1007, [0.0] * dims), (None, [0.5] * dims)]
    return rows + [rows[0]] * 150  # a group of copies


def clustered(spark, rows, dims, **more):
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance int")
    return sorted(map(repr, map(tuple, va_file.clusters(table, dims=dims, **more).collect())))


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_clusters_equal_the_plain_version(spark, monkeypatch, broadcast):
    monkeypatch.setattr(va_file, "BROADCAST_ROWS", broadcast)
    rows = vector_rows()
    assert clustered(spark, rows, 8, k=5, rounds=4) == sorted(map(repr, plain_clusters(rows, 8, 5, 4)))


def test_large_components_are_exact(spark):
    rng = random.Random(23)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(0, 12) for _ in range(3)]) for i in range(60)]
    rows += [(100, [1e300, 0.0, 0.0]), (101, [-1.7e308, 1.7e308, 3.0])]
    assert clustered(spark, rows, 3, k=4, rounds=3) == sorted(map(repr, plain_clusters(rows, 3, 4, 3)))


def test_few_vectors_ties_and_none(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [0.0, 1.0]), (3, [0.5, 0.5])]
    assert clustered(spark, rows, 2, k=8, rounds=3) == sorted(map(repr, plain_clusters(rows, 2, 8, 3)))
    for rows in ([], [(1, None)], [(None, [1.0, 2.0])]):
        assert clustered(spark, rows, 2) == []


def test_only_open_vectors_are_fetched(spark):
    rng = np.random.default_rng(24)
    centres = rng.normal(size=(8, 64)) * 3
    rows = [(i, (centres[i % 8] + rng.normal(size=64) * 0.1).tolist()) for i in range(1600)]
    file = va_file.Clustering(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    file.run(8, 10)
    assert len(file.fetched) >= 1 and sum(file.fetched) < 0.5 * 1600 * len(file.fetched)
    # the rounds read the short forms only
    plan = file.to_fetch([[0] * 64] * 2, [[1] * 64] * 2)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<row:bigint,cells:binary>" in plan


@pytest.mark.parametrize("bits", [1, 3, 4, 8])
def test_intervals_hold_every_distance(bits):
    rng = np.random.default_rng(bits)
    x = rng.integers(-5000, 5000, size=(300, 6))
    edges = [np.sort(np.concatenate([[x[:, d].min(), x[:, d].max()], rng.integers(-4000, 4000, (1 << bits) - 1)])).astype(float).tolist() for d in range(6)]
    edges = [[min(e[0], x[:, d].min()), *e[1:-1], max(e[-1], x[:, d].max())] for d, e in enumerate(edges)]
    cells = np.stack([np.searchsorted(np.array(edges[d][1:-1]), x[:, d], "right") for d in range(6)], axis=1)
    centroids = rng.integers(-5000, 5000, size=(5, 6)).tolist()
    low, high = va_file.tables(edges, centroids)
    exact = va_file.square_distances(x, centroids)
    for c in range(5):
        assert (sum(low[d][c][cells[:, d]] for d in range(6)) <= exact[:, c]).all()
        assert (sum(high[d][c][cells[:, d]] for d in range(6)) >= exact[:, c]).all()


# --- divergence --------------------------------------------------------------

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_divergence(rows, top=200):
    texts = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for _, text, lang, source in rows]
    out = []
    for lang in {x[0] for x in texts}:
        own = [x for x in texts if x[0] == lang]
        df = Counter(t for _, _, words in own for t in set(words))
        kept = sorted(t for t, n in df.items() if n >= 3)
        counts = {s: Counter(t for _, source, words in own if source == s for t in words if df[t] >= 3) for s in {x[1] for x in own}}
        whole = Counter()
        for c in counts.values():
            whole.update(c)
        weigh = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: weigh(c) for s, c in counts.items()}, weigh(whole)
        cost = lambda a, b: (a - b) * (a - b) // b
        for s in counts:
            pairs = sorted((-sum(cost(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s)
            terms = sorted((-cost(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(map(repr, out))


def divergence_rows():
    rng = random.Random(25)
    rows = []
    for i in range(260):
        lang = rng.choice(["en", "de", None, "x"])
        source = "hot" if rng.random() < 0.35 else rng.choice(["a", "b", "c", None, "é", "\U0001F600", "Z"])
        rows.append((i, " ".join(rng.choice(["Ab", "ab", "ÄB", "äb", "c-d", "日本", f"w{rng.randint(0, 40)}x", source or "none", "don't"]) for _ in range(rng.randint(0, 40))), lang, source))
    rows += [(None, "ab ab", "en", "a"), (7, None, "en", "only empty"), (8, "", "lone", "one"), (9, "one two", "two", "p"), (9, "three", "two", "q"), (10, "word " * 50_000, "en", "long")]
    return rows + rows[:3]


@pytest.mark.parametrize("terms, groups, broadcast", [(8192, 256, 200_000), (5, 2, 0)])
def test_divergence_equals_the_plain_version(docs, monkeypatch, terms, groups, broadcast):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", terms)
    monkeypatch.setattr(divergence, "BLOCK_GROUPS", groups)
    monkeypatch.setattr(divergence, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(divergence, "COUNTERS", 50 if groups == 2 else 400_000)
    rows = divergence_rows()
    assert sorted(map(repr, map(tuple, divergence.divergence(docs(rows)).collect()))) == plain_divergence(rows)
    if groups == 2:
        assert sorted(map(repr, map(tuple, divergence.divergence(docs(rows), top=3).collect()))) == plain_divergence(rows, 3)


def test_divergence_of_little(docs):
    assert divergence.divergence(docs([])).collect() == []
    rows = [(1, "a", "en", "s"), (2, None, None, None), (3, "a", "en", "t")]
    assert sorted(map(repr, map(tuple, divergence.divergence(docs(rows)).collect()))) == plain_divergence(rows)


@pytest.mark.parametrize("seed", range(12))
def test_joint_walk_equals_dense_sums(seed):
    rng = np.random.default_rng(seed)
    n, terms = int(rng.integers(1, 9)), int(rng.integers(0, 40))
    empty = rng.integers(1, 1000, n)
    dense = np.repeat(empty[:, None], terms, axis=1)
    filled = rng.random((n, terms)) < rng.choice([0.02, 0.3, 1.0])
    dense[filled] = rng.integers(1, 10**9, int(filled.sum()))
    rows, columns = np.nonzero(filled)
    shuffled = rng.permutation(len(rows))
    got = divergence.joint_walk(rows[shuffled], columns[shuffled], dense[filled][shuffled], empty, terms, states=int(rng.integers(1, 50)))
    for a in range(n):
        for b in range(n):
            assert got[a, b] == (0 if a == b else sum((int(p) - int(q)) ** 2 // int(q) for p, q in zip(dense[a], dense[b])))
