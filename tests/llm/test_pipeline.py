"""The stages on driver tables against plain versions, the registered queries against their SQL."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
from lodegraph.llm import mixing
from lodegraph.llm.queries import ORACLES, QUERIES
from test_dedup import plain_near
from test_text_operators import check_packing
from workload.check import frames_differ

BASE = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not BASE.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for f in BASE.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_over_whole_tables(spark, db, name):
    df = QUERIES[name](spark, str(BASE))
    got = df.toPandas()
    if name in ORACLES:
        assert frames_differ(got, db.execute(ORACLES[name]).df()) is None
    else:
        table = {"op3_vector_graph": "embeddings", "op6_html_rendering": "pages"}.get(name, "documents")
        rows = db.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
        assert len(got) == rows or name == "op7_mixture_packing" and got.doc_id.nunique() == rows


@pytest.mark.parametrize("name", ["op1_line_dedup", "op8_exact_dedup", "op9_personal_data"])
def test_native_operators_run_no_python(spark, name):
    plan = QUERIES[name](spark, str(BASE))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_stages_do_what_they_say(spark, folder):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    columns, frames = docs.columns, [docs.toPandas()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(BASE)).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        frames.append(docs.toPandas())
        if k < 4:
            assert docs.columns == columns, name
    start, spoken, exact, near, mixed, _ = frames
    # clean documents stay: all that hold a letter are recognised here
    assert set(start[start.text.map(lambda t: any(map(str.isalpha, t)))].doc_id) == set(spoken.doc_id)
    assert set(spoken.groupby("text").doc_id.max()) == set(exact.doc_id)
    plain = plain_near(list(zip(exact.doc_id.tolist(), exact.text)), 5)
    assert {r[0] for r in plain if r[3]} == set(near.doc_id)
    drawn = mixing.sampled(spark.read.parquet(f"{folder}/2")).where("kept").toPandas()
    assert set(drawn.doc_id) == set(mixed.doc_id) and 0 < len(mixed) < len(near)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in mixed.itertuples()]
    check_packing(rows, spark.read.parquet(f"{folder}/4").collect())


def test_run_applies_the_stages(spark):
    first, second = (corpus_pipeline.run(spark, str(BASE)).toPandas() for _ in range(2))
    assert frames_differ(first, second) is None and len(first) > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "near dedup", "source mixing", "packing"]
