import random
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodegraph.functions.chunking import chunk_single_units
from lodegraph.functions.vectors import hashing_encoder
from lodegraph.graph import Graph, UnknownLabel
from lodegraph.operators import fulltext
from lodegraph.operators.fulltext import analyze, postings, search_index, search_texts, write_index
from lodegraph.operators.fusion import channel, diversify, fetch_size, fuse
from lodegraph.operators.pairs import coverage, gaps
from lodegraph.operators.sampling import stride_sample
from lodegraph.operators.segmented import running_rank
from lodegraph.operators.similarity import nearest
from lodegraph.operators.topn import first_per_group
from lodegraph.operators.vector_index import sliced
from lodegraph.operators.traversal import comention_counts
from lodegraph.operators.versioning import replay
from lodegraph.plans.analytics import gap_matrix, knowledge_gaps, measurement_report, risk_pairs, verified
from lodegraph.plans.answer import answer_question, fragments, parse_question
from lodegraph.plans.search import check_request, document_filter, hybrid_search, semantic_search, with_entities

WORDS = "медь никель плавка обжиг шлак штейн флотация copper nickel smelting roast slag".split()


@pytest.fixture(scope="module")
def corpus(spark):
    random.seed(7)
    docs = [(f"D{i}", f"Doc {i}", random.choice(["статья", "обзор", None]), random.choice([2001, 2010, None]), random.choice(["ru", "en"]))
            for i in range(30)]
    chunks = []
    for d, *_ in docs:
        for seq in range(1, 6):
            text = " ".join(random.choice(WORDS) for _ in range(random.randint(3, 12)))
            # a third of all chunks are copies of one text
            chunks.append((f"{d}:{seq}", d, seq, 1, "page", "медь плавка шлак" if random.random() < 0.35 else text))
    encode = hashing_encoder(32)
    rows = [(*c, encode([c[5]])[0]) for c in chunks]
    return Graph(
        nodes={
            "Document": spark.createDataFrame(docs, "id string, title string, category string, year int, language string").cache(),
            "Chunk": spark.createDataFrame(rows, "id string, doc_id string, seq int, unit_no int, unit_kind string, text string, embedding array<double>").cache(),
            "Material": spark.createDataFrame([("M:медь", "медь", ["Cu"])], "id string, name string, synonyms array<string>"),
            "Process": spark.createDataFrame([("P:обжиг", "обжиг", None)], "id string, name string, synonyms array<string>"),
            "Measurement": spark.createDataFrame(
                [("D3:1", "температура обжига", 650.0, 700.0, "°C"), ("D4:2", "температура обжига", 900.0, None, "°C"),
                 ("D5:1", "выход", 650.0, None, "%")], "source string, property string, value double, value_max double, unit string"),
        },
        edges={"MENTIONS": spark.createDataFrame(
            [(f"D{i}", label, key, i, f"D{i}:{1 + i % 5}") for i in range(12) for label, key in (("Material", "M:медь"), ("Process", "P:обжиг")) if i % 3 or label == "Material"],
            "src_id string, dst_label string, dst_id string, count bigint, source string")},
    )


def test_diversity_pass_equals_a_sequential_walk(spark):
    random.seed(3)
    for k in (1, 3, 10, 40):
        rows = [(p, f"c{p}", f"d{random.randint(0, 6)}", random.choice(["", "s1", "s2", "s3", f"u{p}"])) for p in range(1, 80)]
        kept, per_doc, seen = [], {}, set()
        for p, c, d, s in rows:
            if len(kept) == k:
                break
            if (s and s in seen) or per_doc.get(d, 0) >= 2:
                continue
            kept.append(c)
            per_doc[d] = per_doc.get(d, 0) + 1
            seen.add(s)
        random.shuffle(rows)
        got = diversify(spark.createDataFrame(rows, "position int, chunk_id string, doc_id string, signature string"), k)
        assert [r["chunk_id"] for r in got.orderBy("place").collect()] == kept
        assert [r["place"] for r in got.orderBy("place").collect()] == list(range(1, len(kept) + 1))


def test_fusion_scores_and_ties(spark):
    frame = lambda ids, name: channel(spark.createDataFrame([(c, i) for i, c in enumerate(ids, 1)], "chunk_id string, rank int"), name)
    got = fuse([frame(["a", "b"], "vector"), frame(["b", "c"], "fulltext"), frame(["d"], "graph")]).orderBy("position").collect()
    assert [r["chunk_id"] for r in got] == ["b", "a", "d", "c"]
    assert got[0]["rrf_score"] == pytest.approx(1 / 62 + 1 / 61)
    assert [r["via_graph"] for r in got] == [False, False, True, False]
    assert fetch_size(3) == 40 and fetch_size(30) == 150


def test_stored_index_ranks_like_the_scan(spark, corpus, folder):
    chunks = corpus.node("Chunk")
    write_index(chunks, f"{folder}/index")
    for query in ("плавка меди", "copper (slag)", "нет такого", "?"):
        scan = [(r["chunk_id"], round(r["score"], 9)) for r in search_texts(chunks, query, 15).orderBy("rank").collect()]
        index = [(r["chunk_id"], round(r["score"], 9)) for r in search_index(spark, f"{folder}/index", query, 15).orderBy("rank").collect()]
        assert scan == index


def test_nearest_is_exact_and_skips_missing(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", None), ("d", [3.0, 3.0])], "id string, embedding array<float>")
    got = nearest(df, [0.0, 1.0], 10).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["b", "d", "a"]
    assert got[1]["score"] == pytest.approx(2 ** -0.5)


def test_hybrid_search_filters_and_limits(corpus):
    hits = hybrid_search(corpus, "плавка меди", k=8, encoder=hashing_encoder(32), entity_keys=["M:медь", "P:обжиг"]).collect()
    assert [h["place"] for h in hits] == list(range(1, len(hits) + 1)) and len(hits) == 8
    assert max(map([h["doc_id"] for h in hits].count, {h["doc_id"] for h in hits})) <= 2
    texts = [h["text"] for h in hits]
    assert len(set(texts)) == len(texts)
    again = hybrid_search(corpus, "плавка меди", k=8, encoder=hashing_encoder(32), entity_keys=["M:медь", "P:обжиг"], lookup=True).collect()
    assert again == hits
    only = hybrid_search(corpus, "плавка меди", k=8, allowed_categories=["статья"], year_from=2005, language="ru").collect()
    assert all(h["category"] == "статья" and h["year"] == 2010 and h["language"] == "ru" for h in only)
    entities = with_entities(corpus, hybrid_search(corpus, "обжиг", k=30)).collect()
    assert all(isinstance(h["entities"], list) for h in entities)


def test_hidden_documents_take_no_place_of_visible_ones(spark):
    docs = [(str(i), "t", "open" if i >= 300 else "closed", "en", 2000) for i in range(310)]
    chunks = [(f"{i}:1", str(i), 1, 1, "page", ("copper " if i >= 300 else "copper copper ") + f"w{i}", [1.0, 0.01 * (i >= 300)]) for i in range(310)]
    mentions = [(str(i), "Material", "M", 1 if i >= 300 else 9, f"{i}:1") for i in range(310)]
    graph = Graph(nodes={
        "Document": spark.createDataFrame(docs, "id string, title string, category string, language string, year int"),
        "Chunk": spark.createDataFrame(chunks, "id string, doc_id string, seq int, unit_no int, unit_kind string, text string, embedding array<double>"),
    }, edges={"MENTIONS": spark.createDataFrame(mentions, "src_id string, dst_label string, dst_id string, count long, source string")})
    ranked = spark.createDataFrame([(f"{i}:1", i + 1) for i in range(310)], "chunk_id string, rank int")
    hits = lambda **more: hybrid_search(graph, "copper", [1.0, 0.0], k=5, allowed_categories=["open"], **more).collect()
    for found in (hits(), hits(entity_keys=["M"], measured=ranked), hits(fulltext=ranked, lookup=True)):
        assert len(found) == 5 and all(int(h["doc_id"]) >= 300 for h in found)
    assert semantic_search(graph, [1.0, 0.0], 5, allowed_categories=["open"]).count() == 5


def test_vectors_without_direction_are_no_candidates(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("z", [0.0, 0.0]), ("n", [float("nan"), 1.0])], "id string, embedding array<float>")
    assert [r["chunk_id"] for r in nearest(df, [1.0, 0.0], 3).collect()] == ["a"]
    assert nearest(df, [0.0, 0.0], 3).collect() == []


def test_semantic_search(corpus):
    got = semantic_search(corpus, hashing_encoder(32)(["медь плавка шлак"])[0], k=5, language="en").collect()
    assert len(got) <= 5 and all(r["language"] == "en" for r in got) and got[0]["score"] == pytest.approx(1.0)


def test_filters_drop_null_columns(corpus):
    docs = corpus.node("Document")
    assert document_filter(docs, year_to=2005).where("year is null").count() == 0
    assert document_filter(docs, allowed_categories=["статья", "обзор"]).where("category is null").count() == 0
    assert document_filter(docs).count() == 30


@pytest.mark.parametrize("bad", [dict(query="x"), dict(k=0), dict(k=31), dict(language="de"), dict(year_from=1800), dict(year_from=2010, year_to=2000)])
def test_request_bounds(bad):
    check_request("ok", 5, 30)
    with pytest.raises(ValueError):
        check_request(**{"query": "ok", "k": 5, "k_max": 30, **bad})


class Model:
    model = "fake"

    def __init__(self, parsed=None):
        self.parsed, self.asked = parsed, []

    def complete_text(self, system, user, max_tokens=2048):
        self.asked.append((system, user))
        return self.parsed if "JSON search filters" in system else "answer [1]"


def test_answer(corpus):
    plain = answer_question(corpus, "обжиг меди", encoder=hashing_encoder(32), k=3)
    assert plain["answer"] is None and plain["filters"]["entities"] == ["медь", "обжиг"] and len(plain["citations"]) == 3
    model = Model('{"query": "обжиг", "year_from": 2001, "category": "обзор", "geography": "РФ", "constraints": ['
                  '{"property": "температура обжига", "op": "range", "value": 600, "value_max": 700, "unit": "°C"}, {"property": "x"}]}')
    full = answer_question(corpus, "обжиг меди", model, k=30, overrides={"category": None, "year_from": 1990, "language": "ru"}, year=2024)
    assert full["answer"] == "answer [1]" and "2024" in model.asked[0][0]
    assert full["filters"]["year_from"] == 1990 and full["filters"]["category"] == "обзор" and len(full["filters"]["constraints"]) == 1
    assert all(c["category"] == "обзор" for c in full["citations"])
    assert "[1] «" in model.asked[1][1]
    assert parse_question(Model("no json"), "q") == {"query": "q"}


def test_fragment_text(spark):
    row = spark.createDataFrame([(1, "T", "T", None, "Conf", "c", 2001, "page", 3, "text")],
                                "place int, display_title string, title string, journal string, conference string, category string, year int, unit_kind string, unit_no int, text string")
    assert fragments(row).first()["block"] == "[1] «T» (Conf, 2001; page 3)\ntext"


def test_pairs_with_many_buckets(spark):
    left = spark.createDataFrame([(f"m{i}",) for i in range(7)], "key string")
    right = spark.createDataFrame([(f"p{i}",) for i in range(11)], "key string")
    counts = spark.createDataFrame([(f"m{i}", f"p{j}", i + j) for i in range(7) for j in range(11) if (i * j) % 3 == 1], "left_key string, right_key string, docs int")
    known = {(r[0], r[1]): r[2] for r in counts.collect()}
    for size, few in ((2, 50_000), (1024, 50_000), (4, 5)):
        cells = {(r["left_key"], r["right_key"]): r["docs"] for r in coverage(left, right, counts, size, few).collect()}
        assert cells == {(f"m{i}", f"p{j}"): known.get((f"m{i}", f"p{j}"), 0) for i in range(7) for j in range(11)}
        missing = {(r["left_key"], r["right_key"]) for r in gaps(left, right, counts, size, few).collect()}
        assert missing == {pair for pair in cells if pair not in known}


@pytest.fixture
def covered(spark):
    """A graph with repeated keys and edges, a missing key and a name without a document."""
    rng = random.Random(7)
    edges = [(str(rng.randint(0, 30)), label, f"{label[0]}{rng.randint(0, 9)}") for label in ("Material", "Process") for _ in range(80)]
    nodes = {label: [(f"{label[0]}{i}", f"name {i}", i == 3) for i in range(12)] + [(f"{label[0]}1", "second", None), (None, None, False)]
             for label in ("Material", "Process")}
    graph = Graph(nodes={k: spark.createDataFrame(v, "id string, name string, needs_review boolean") for k, v in nodes.items()},
                  edges={"MENTIONS": spark.createDataFrame(edges, "src_id string, dst_label string, dst_id string")})
    known = {k: [(key, name) for key, name, flag in v if key and not flag] for k, v in nodes.items()}
    docs = Counter((m, p) for d, a, m in edges for e, b, p in edges if d == e and a == "Material" and b == "Process")
    return graph, known, docs


def test_pairs_are_counted_in_tasks_of_bounded_rows(spark, covered):
    graph, known, docs = covered
    wanted = {k: v for k, v in docs.items() if "M3" != k[0] and "P3" != k[1]}
    sides = [verified(graph, label) for label in ("Material", "Process")]
    for rows in (10, 1_000_000):
        counts = comention_counts(graph.mentions(), *sides, "Material", "Process", task_rows=rows)
        assert {(r.left_key, r.right_key): r.docs for r in counts.collect()} == wanted
        # more edges than two parts of ten rows hold
        plan = counts._jdf.queryExecution().optimizedPlan().toString()
        assert ("RepartitionByExpression [doc_id" in plan) == (rows == 10)
        left, right = [side.select("key").distinct() for side in sides]
        cells = {(r.left_key, r.right_key): r.docs for r in coverage(left, right, counts, task_rows=rows).collect()}
        keys = [{k for k, _ in known[label]} for label in ("Material", "Process")]
        assert {k: n for k, n in cells.items() if k[0]} == {(m, p): wanted.get((m, p), 0) for m in keys[0] for p in keys[1]}


def test_named_pairs_are_not_dealt_by_the_short_side(covered):
    graph, known, docs = covered
    # names of a repeated key: each with each of the rows that have it
    times = Counter(key for key, _ in known["Material"])
    want = Counter()
    for m, material in known["Material"]:
        for p, process in known["Process"]:
            want[(m, material, p, process, docs.get((m, p), 0))] += times[m]
    matrix, gap, risk = gap_matrix(graph), knowledge_gaps(graph), risk_pairs(graph, n=None)
    columns = ("material_key", "material", "process_key", "process")
    assert Counter(tuple(r) for r in matrix.select(*columns, "docs").collect()) == want
    assert Counter(tuple(r) for r in gap.select(*columns).collect()) == Counter({k[:4]: n for k, n in want.items() if not k[4]})
    assert Counter(tuple(r) for r in risk.select(*columns, "docs").collect()) == Counter(k for k in want if 1 <= k[4] <= 3)
    for frame in (matrix, gap, risk):
        assert "hashpartitioning(right_key" not in frame._jdf.queryExecution().executedPlan().toString()


def test_segmented_ranks_and_samples(spark):
    rows = [("hot", s) for s in range(0, 900, 3)] + [("b", 5), ("b", 7)]
    df = spark.createDataFrame(rows, "doc_id string, seq int")
    ranked = running_rank(df, ["doc_id"], ["seq"], F.floor(F.col("seq") / 50), "r").collect()
    assert all(r["r"] == (r["seq"] // 3 + 1 if r["doc_id"] == "hot" else {5: 1, 7: 2}[r["seq"]]) for r in ranked)
    picked = sorted(r["seq"] for r in stride_sample(df, 8, F.floor(F.col("seq") / 50)).where("doc_id = 'hot'").collect())
    assert picked == sorted(3 * round(i * 299 / 7) for i in range(8))
    with pytest.raises(ValueError):
        stride_sample(df, 1, F.lit(0))


def test_replay_equals_a_sequential_count(spark):
    random.seed(5)
    rows = [("hot" if random.random() < 0.4 else f"k{random.randint(0, 3)}", i, random.choice("ab"), random.choice([0.5, None]), random.choice(["", None, "x"]))
            for i in range(400)]
    state, want = {}, {}
    for key, i, text, sure, place in rows:
        if key not in state:
            state[key] = (text, sure, place, 1)
        else:
            t, s, p, v = state[key]
            changed = text != t or (sure is not None and s is not None and sure != s) or (place or "") != (p or "")
            state[key] = (text, sure, place, v + changed)
        want[i] = state[key][3]
    log = spark.createDataFrame(rows, "key string, at int, text string, confidence double, geography string")
    got = replay(log, "key", ["at"], F.floor(F.col("at") / 25)).collect()
    assert {r["at"]: r["version"] for r in got} == want


def test_first_of_each_group(spark):
    df = spark.createDataFrame([("s", 3, "c"), ("s", 1, "a"), ("t", 2, "b")], "sig string, rank int, id string")
    assert sorted(tuple(r) for r in first_per_group(df, ["sig"], [F.col("rank")]).collect()) == [("s", 1, "a"), ("t", 2, "b")]


def test_unknown_labels_are_refused(corpus):
    with pytest.raises(UnknownLabel):
        corpus.node("Planet")


@pytest.fixture
def cut_graph(spark):
    """Documents whose chunks are cut when they are asked for."""
    docs = spark.createDataFrame([(f"D{i}", "медь плавка шлак. " * (90 * i), "ru" if i % 2 else "en") for i in range(6)], "doc_id string, text string, language string")
    return Graph(nodes={"Document": docs.select(F.col("doc_id").alias("id"), F.lit("t").alias("title"), "language"), "Chunk": chunk_single_units(docs),
                        "Material": spark.createDataFrame([("M:медь", "медь")], "id string, name string")},
                 edges={"MENTIONS": spark.createDataFrame([("D1", "Material", "M:медь", 1, "D1:1")], "src_id string, dst_label string, dst_id string, count bigint, source string")})


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_cut_in_small_batches(cut_graph):
    assert "BatchEvalPython" in plan_of(cut_graph.node("Chunk")) and "ArrowEvalPython" not in plan_of(cut_graph.node("Chunk"))


def test_texts_are_analysed_once(cut_graph):
    found = search_texts(cut_graph.node("Chunk"), "плавка", 3)
    assert "split(" not in plan_of(found) and "regexp" not in plan_of(found) and found.count() == 3


def test_filtered_channels_do_not_cut_the_texts_anew(spark, cut_graph):
    vectors = spark.createDataFrame([("D1:1", [1.0, 0.0]), ("D2:1", [0.0, 1.0])], "id string, embedding array<double>")
    hits = hybrid_search(cut_graph, "плавка", [1.0, 0.5], language="ru", vectors=vectors, entity_keys=["M:медь"])
    assert plan_of(hits).count("EvalPython [split(") == 1
    assert {r["doc_id"] for r in hits.collect()} <= {"D1", "D3", "D5"}
    assert "split(" not in plan_of(with_entities(cut_graph, hits))


def test_batches_are_placed_in_pieces():
    batch = pa.RecordBatch.from_arrays([pa.array(range(10))], ["x"])
    assert [b.column(0).to_pylist() for b in sliced(iter([batch, batch.slice(0, 0)]), 4)] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]


def test_measurements_are_not_dealt_by_property(spark):
    rows = [(f"D{i % 5}", f"p{i % 3}", float(i), None, None, None, "here") for i in range(20)]
    graph = Graph(nodes={
        "Measurement": spark.createDataFrame(rows, "doc_id string, property string, value double, value_max double, unit string, conditions string, place string"),
        "Property": spark.createDataFrame([("p0",), ("p0",), ("p1",)], "name string"),
        "Document": spark.createDataFrame([(f"D{i}", f"doc {i}") for i in range(4)], "id string, title string")})
    found = measurement_report(graph)
    assert "Exchange hashpartitioning(property" not in plan_of(found)
    assert sorted(r["value"] for r in found.collect()) == [float(i) for i in range(20) if i % 3 < 2 and i % 5 < 4]


def test_postings_cut_endings_of_single_words(spark):
    texts = [("a", "Wörter, WORDS words word wor Ёлки ёлка 1234567 123456 12345 123 x"), ("b", ""), ("c", None), ("a", "words again")]
    docs = spark.createDataFrame(texts, "id string, text string")
    found = postings(docs)
    want = {}
    for row in docs.where("text is not null").select("id", analyze("text").alias("w")).collect():
        for term in ["", *row.w]:
            want[term, row.id] = want.get((term, row.id), 0) + 1
    assert {(r.term, r.chunk_id): r.tf for r in found.collect()} == want
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_an_index_of_shares_and_ranges(spark, folder, monkeypatch):
    """Texts analysed a share at a time and postings ordered range by range are those of one step, and no shuffle files stay."""
    rng = random.Random(71)
    rows = [(f"d{i}", " ".join(rng.choice(["Red", "blue", "жёлтый", "melting", "of", "ores", "x1"]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    rows += [rows[1], (None, "blue without an id"), ("n", None), ("e", "")]
    table = spark.createDataFrame(rows, "id string, text string")
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    found = []
    for k, (chars, most) in enumerate([(10**9, 10**9), (1500, 60)]):
        monkeypatch.setattr(fulltext, "SHARE_CHARS", chars)
        monkeypatch.setattr(fulltext, "SHARE_ROWS", most)
        path, count = f"{folder}/index{k}", files()
        fulltext.write_index(table.where("id is null or id < 'd3'"), path)
        fulltext.update_index(table.where("id >= 'd2'"), path)
        until = time.time() + 30
        while files() > count + 40 and time.time() < until:
            time.sleep(1)
        assert files() <= count + 40
        segments = fulltext._index(spark, path)
        state = segments.state()
        posts = segments.read(state).select("term", "chunk_id", "tf").collect()
        hits = [(r.chunk_id, round(r.score, 9), r.rank) for r in fulltext.search_index(spark, path, "red ores melting", 20).collect()]
        found.append((sorted(map(repr, posts)), [s["totals"] for s in state["segments"].values()], sorted(map(repr, hits))))
    for one, other in zip(*found):
        assert one == other
    assert len(found[0][2]) == 20
    assert len(fulltext._ranges(spark.createDataFrame([(f"w{i % 50:02d}", str(i), 1) for i in range(600)], "term string, chunk_id string, tf int"))) > 5
