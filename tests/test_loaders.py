import json
import os

import pytest

from lodegraph.plans.analytics import node_counts
from lodegraph.sources import tabular

FILES = {
    "materials.csv": '﻿id,grade,synonyms,composition\nM1,ВТ6,Ti-6Al-4V|ВТ-6,"{""Al"": 6.0, ""Ti"": ""осн.""}"\n'
                     'M2,АМг6,AMg6,\nM3,Bad,,not json\nM4,Clash,ВТ 6,\n',
    "equipment.csv": "id,type,lab\nE1,печь,Л1\n",
    "staff.csv": "id,name,lab\nS1,Иванова,Л1\n",
    "properties.csv": "name,category\nпрочность,механические\n",
    "documents.csv": "id,doc_type,date,title,authors\nD1,отчёт,2023-11-20,Об отжиге,S1|S9\nD2,отчёт,someday,Bad,S1\n",
}


def experiment(**changes):
    base = {
        "id": "X1", "date": "2024-01-02", "goal": "g", "status": "s", "material": "AMg6", "equipment_id": "E1",
        "regime": {"type": "отжиг", "temp_min": 750, "temp_max": 800, "duration_h": 2, "medium": "вакуум"},
        "measurements": [
            {"property": "шероховатость", "value": 1, "unit": "Ra", "method": "m"},
            {"property": "прочность", "value": "950", "unit": "МПа", "method": "m", "uncertainty": 15}],
        "conclusions": [{"text": "c", "confidence": 0.9, "date": "2024-01-03", "doc_id": "D1", "fragment": "p. 1"}],
    }
    return json.dumps({**base, **changes}, ensure_ascii=False)


LINES = [
    experiment(),
    "",
    experiment(id="X2", conclusions=[{
        "text": "d", "confidence": 0.5, "date": "2024-02-03", "doc_id": "D7",
        "relates": [{"type": "supports", "target": "X1:C1"}, {"type": "contradicts", "target": "nowhere"}]}]),
    "{broken",
    experiment(id="X3", material="ВТ22"),
    experiment(id="X4", equipment_id="E9"),
    experiment(id="X5", regime={"type": "t", "temp_min": 9, "temp_max": 1}),
    experiment(id="X6", conclusions=[{"text": "c", "confidence": 1.5, "date": "2024-01-03"}]),
]


@pytest.fixture
def sources(folder):
    for name, text in FILES.items():
        with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
            f.write(text)
    with open(f"{folder}/experiments.jsonl", "w", encoding="utf-8") as f:
        f.write("\n".join(LINES) + "\n")
    return folder


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_load_all(store, sources):
    results = tabular.load_all(store, sources, "2024-03-01T00:00:00+00:00")
    materials = results["materials"]
    assert ids(store.read("Material")) == ["M1", "M2", "M4"]
    assert ids(materials.rejected, "record") == ["M3"]
    assert [r["record"] for r in materials.warnings.collect()] == ["M4"]
    row = store.read("Material").where("id = 'M1'").first()
    assert row["composition"] == {"Al": "6.0", "Ti": "осн."} and row["synonyms"] == ["Ti-6Al-4V", "ВТ-6"]

    documents = results["documents"]
    assert ids(documents.rejected, "record") == ["D2"]
    assert "S9" in documents.warnings.first()["reason"]
    edge = store.read("AUTHORED_BY").first()
    assert (edge["src_id"], edge["dst_id"], edge["source"], edge["confidence"]) == ("D1", "S1", "documents.csv#D1", 1.0)

    loaded = results["experiments"]
    assert ids(store.read("Experiment")) == ["X1", "X2"]
    reasons = {r["record"]: r["reason"] for r in loaded.rejected.collect()}
    assert set(reasons) == {"line 4", "X3", "X4", "line 7", "line 8"}
    # both experiments share one regime; the skipped measurement keeps its number
    assert store.read("Regime").count() == 1
    assert ids(store.read("Measurement")) == ["X1:M2", "X2:M2"]
    assert ids(store.read("Conclusion")) == ["X1:C1", "X2:C1"]
    assert [tuple(r) for r in store.read("SUPPORTS").select("src_id", "dst_id").collect()] == [("X2:C1", "X1:C1")]
    assert store.read("CONTRADICTS").count() == 0
    assert ids(store.read("DESCRIBED_IN"), "src_id") == ["X1:C1"]
    assert loaded.warnings.count() == 4
    assert "rejected: 5" in loaded.report()


def test_loading_twice_changes_nothing(store, sources):
    def state():
        return {r["label"]: r["n"] for r in node_counts(store.graph()).collect()}

    tabular.load_all(store, sources, "t1")
    first, regimes = state(), ids(store.read("Regime"), "key")
    tabular.load_all(store, sources, "t2")
    assert state() == first and ids(store.read("Regime"), "key") == regimes


def test_seed(store, folder):
    with open(f"{folder}/materials.csv", "w", encoding="utf-8") as f:
        f.write("name,name_en,synonyms,kind\nникель,nickel,Ni,металл\n ,x,,\nшлак,,,\n")
    counts = tabular.load_seed(store, folder)
    assert counts == {"materials.csv": 2, "processes.csv": None, "equipment.csv": None}
    row = store.read("Material").where("id = 'M:никель'").first()
    assert row["synonyms"] == ["никель", "nickel", "Ni"] and row["needs_review"] is False and row["kind"] == "металл"


def test_line_numbers_survive_file_splits(spark, folder):
    with open(f"{folder}/lines.txt", "w", encoding="utf-8") as f:
        f.writelines(f"{i}\n" for i in range(1, 5001))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = tabular.numbered_lines(spark, f"{folder}/lines.txt").collect()
        assert all(str(r["line_no"]) == r["line"] for r in rows) and len(rows) == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_sample_layout_is_known():
    assert list(tabular.LOADERS) == ["materials", "equipment", "staff", "properties", "documents", "experiments"]
    assert os.path.basename(tabular.LOADERS["experiments"][0]) == "experiments.jsonl"
