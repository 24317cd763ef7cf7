import json
import random
import sys

import pytest
from pyspark import cloudpickle

from lodegraph.extraction.client import ModelError, RetryingClient, RuleClient, complete_json, object_in
from lodegraph.extraction.pipeline import extract, save
from lodegraph.extraction.schema import read_answers
from lodegraph.plans.analytics import conclusion_history
from lodegraph.operators.resolve import new_entities

ANSWER = {
    "materials": [{"name": "Ni"}, "Новый сплав"],
    "processes": [{"name": "спекание", "name_en": "sintering"}, "sintering"],
    "facilities": ["Nikkelverk (Норвегия)"],
    "measurements": [
        {"property": " извлечение ", "value": "95,5 %"}, {"property": "bad", "value": "много"}, {"property": "none"},
        {"property": "ток", "value": "200-240", "unit": "А", "conditions": [
            {"parameter": "t", "value": "60°C"}, {"parameter": "x", "value": "тепло"}]}],
    "conclusions": [{"text": "работает", "materials": ["никель"], "processes": ["обжиг"], "confidence": 0.5}, "просто"],
    "topics": [" Экология "], "authors": [{"name": " Петров П.П. "}, ""],
}


# executors do not import test modules
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Fixed:
    model = "fixed-1"

    def __init__(self, answer):
        self.answer = answer

    def complete_text(self, system, user, max_tokens=2048):
        if "fail" in user:
            raise ModelError("down", 400)
        return "```json\n" + json.dumps(self.answer) + "\n```"


@pytest.fixture
def loaded(store):
    rows = lambda label, data, schema: store.merge_nodes(label, store.spark.createDataFrame(data, schema))
    rows("Material", [("M:никель", "никель", ["никель", "nickel", "Ni"], False)], "id string, name string, synonyms array<string>, needs_review boolean")
    rows("Document", [("D1", "Статья", "статья", 2020)], "id string, title string, category string, year int")
    rows("Chunk", [("D1:1", "D1", 1, 1, "page", "текст"), ("D1:2", "D1", 2, 2, "page", "fail")],
         "id string, doc_id string, seq int, unit_no int, unit_kind string, text string")
    return store


def test_extraction_writes_facts_with_provenance(loaded):
    facts = extract(loaded, lambda: Fixed(ANSWER), "fixed-1", "t1")
    assert [(r["record"], r["reason"]) for r in facts.rejected.collect()] == [("D1:2", "ModelError: down")]
    materials = {r["id"]: r for r in loaded.read("Material").collect()}
    assert set(materials) == {"M:никель", "M:новыйсплав"}
    assert materials["M:никель"]["needs_review"] is False and materials["M:новыйсплав"]["needs_review"] is True
    # the second mention is the first one's English name
    processes = {r["id"]: r for r in loaded.read("Process").collect()}
    assert set(processes) == {"P:спекание", "P:обжиг"} and processes["P:спекание"]["name_en"] == "sintering"
    counts = {(r["dst_label"], r["dst_id"]): r["count"] for r in loaded.read("MENTIONS").collect()}
    assert counts == {("Material", "M:никель"): 1, ("Material", "M:новыйсплав"): 1, ("Process", "P:спекание"): 2,
                      ("Facility", "Nikkelverk"): 1}
    edge = loaded.read("MENTIONS").where("dst_id = 'M:никель'").first()
    assert (edge["source"], edge["unit"], edge["confidence"], edge["model"]) == ("D1:1", "page 1", 0.8, "fixed-1")
    assert loaded.read("Facility").first()["country"] == "Норвегия"
    measured = {r["id"]: r for r in loaded.read("Measurement").collect()}
    # unreadable numbers are dropped before numbering
    assert set(measured) == {"D1:1:M1", "D1:1:M2"}
    assert (measured["D1:1:M1"]["property"], measured["D1:1:M1"]["value"], measured["D1:1:M1"]["unit"]) == ("извлечение", 95.5, "%")
    second = measured["D1:1:M2"]
    assert (second["value"], second["value_max"]) == (200, 240)
    assert [(c["value"], c["unit"], c["raw"]) for c in second["conditions"]] == [(60, "°C", None), (None, None, "тепло")]
    assert {r["name"] for r in loaded.read("Property").where("needs_review").collect()} == {"извлечение", "ток"}
    conclusions = {r["id"]: r for r in loaded.read("Conclusion").collect()}
    assert conclusions["D1:1:C1"]["needs_review"] is True and conclusions["D1:1:C2"]["needs_review"] is False
    assert str(conclusions["D1:1:C1"]["date"]) == "2020-01-01" and conclusions["D1:1:C1"]["version"] == 1
    about = {(r["dst_label"], r["dst_id"]) for r in loaded.read("ABOUT").collect()}
    assert about == {("Material", "M:никель"), ("Process", "P:обжиг")}
    assert [r["name"] for r in loaded.read("TopicTag").collect()] == ["экология"]
    assert [r["id"] for r in loaded.read("Person").collect()] == ["P:петровп.п."]
    # resumable: only the failed chunk is still open
    assert [r["id"] for r in loaded.read("ChunkState").collect()] == ["D1:1"]
    assert extract(loaded, lambda: Fixed(ANSWER), "fixed-1", "t2").done.count() == 0


def test_changed_conclusions_are_versioned(loaded):
    first = {"conclusions": [{"text": "a", "confidence": 0.6}]}
    extract(loaded, lambda: Fixed(first), "m1", "t1")
    extract(loaded, lambda: Fixed(first), "m1", "t2", force=True)
    row = conclusion_history(loaded.graph(), "D1:1:C1").first()
    assert row["version"] == 1 and row["history"] == []
    extract(loaded, lambda: Fixed({"conclusions": [{"text": "a", "confidence": 0.9, "geography": "РФ"}]}), "m2", "t3", force=True)
    row = conclusion_history(loaded.graph(), "D1:1:C1").first()
    assert (row["version"], row["confidence"], row["geography"], row["updated_at"]) == (2, 0.9, "РФ", "t3")
    assert [(h["version"], h["confidence"], h["archived_by_model"]) for h in row["history"]] == [(1, 0.6, "m2")]


def test_a_repeated_save_changes_nothing(loaded):
    facts = extract(loaded, lambda: Fixed(ANSWER), "fixed-1", "t1")
    state = lambda: {n: sorted(map(str, loaded.read(n).collect())) for n in ("MENTIONS", "Conclusion", "ConclusionVersion", "Measurement", "ABOUT", "REPORTS", "TAGGED")}
    before = state()
    save(loaded, facts)
    assert state() == before
    extract(loaded, lambda: Fixed(ANSWER), "fixed-1", "t1", force=True)
    assert {k: len(v) for k, v in state().items()} == {k: len(v) for k, v in before.items()}


def test_edges_without_ends_are_left_out(loaded, spark):
    loaded.merge_edges("AUTHORED_BY", spark.createDataFrame([("D1", "nobody"), ("nothing", "P:x")], "src_id string, dst_id string"))
    assert loaded.read("AUTHORED_BY").count() == 0


def read(spark, *answers):
    rows = [(a if isinstance(a, str) else json.dumps(a),) for a in answers]
    return [r.asDict(True) for r in spark.createDataFrame(rows, "raw string").coalesce(1).transform(read_answers).withColumnRenamed("problem", "error").collect()]


def test_answers_are_read_leniently(spark):
    good = {"topics": ["a", 5], "authors": [{"name": "B"}, {"x": 1}, "C"], "facilities": ["Nikkelverk (Норвегия)", {"name": " N ", "country": "РФ"}, "x (y"]}
    found = read(spark, f"Here: ```json\n{json.dumps(good)}``` done", "nothing", '{"a": 1', {}, {"materials": None}, {"materials": [" "]}, {"processes": [3]})
    assert found[0]["error"] is None and found[0]["topics"] == ["a", "5"] and found[0]["authors"] == ["B", "", "C"]
    assert [(f["name"], f["country"]) for f in found[0]["facilities"]] == [("Nikkelverk", "Норвегия"), ("N", "РФ"), ("x (y", None)]
    assert [f["error"] is None for f in found[1:]] == [False, False, True, False, False, False]
    assert found[3]["materials"] == [] and found[4]["topics"] is None


def test_numbers_of_an_answer(spark):
    condition = lambda **c: {"measurements": [{"property": "p", "value": 1, "conditions": [{"parameter": "t", **c}]}]}
    cases = [
        ({"value": "1-2"}, ("range", 1.0, 2.0, None, None)), ({"value": "1-2", "value_max": None, "op": "<="}, ("<=", 1.0, None, None, None)),
        ({"value": "60 °C", "unit": ""}, ("=", 60.0, None, "°C", None)), ({"value": "60 °C", "unit": "K"}, ("=", 60.0, None, "K", None)),
        ({"value": "warm"}, ("=", None, None, None, "warm")), ({"value": 5, "value_max": "7"}, ("=", 5.0, 7.0, None, None)), ({}, ("=", None, None, None, None)),
    ]
    for (_, want), got in zip(cases, read(spark, *[condition(**c) for c, _ in cases])):
        row = got["measurements"][0]["conditions"][0]
        assert (row["op"], row["value"], row["value_max"], row["unit"], row["raw"]) == want
    bad = [condition(op=None), condition(value=[1]), condition(value_max="x"), condition(unit=3), {"measurements": [5]}, {"measurements": [{"value": 1}]},
           {"conclusions": [{"text": "x", "confidence": 2}]}, {"conclusions": [{"text": "x", "confidence": None}]}, {"conclusions": [{"confidence": 0.5}]}]
    assert all(r["error"] for r in read(spark, *bad))
    measured = {"measurements": [
        {"property": "a", "value": "1-2", "value_max": None}, {"property": "b", "value": "x"}, {"property": "c"}, {"value": "none at all"}, {"property": "d", "value": True},
        {"property": "e", "value": 3, "value_max": "4-6 %"}, {"property": "f", "value": "-0,25 В", "value_max": "?", "conditions": None}]}
    rows = read(spark, measured)[0]["measurements"]
    assert [(m["property"], m["value"], m["value_max"], m["unit"]) for m in rows] == [("a", 1.0, None, None), ("e", 3.0, 6.0, None), ("f", -0.25, None, "В")]
    sure = read(spark, {"conclusions": ["plain", {"text": "t", "confidence": "0.4", "materials": ["a", 1]}]})[0]["conclusions"]
    assert [(c["text"], c["confidence"], c["materials"]) for c in sure] == [("plain", 0.7, []), ("t", 0.4, ["a", "1"])]


def test_values_of_an_answer_are_asked_for_once(spark):
    frame = spark.createDataFrame([('{"topics": [1, "a", {"b": null}], "authors": [{"name": 2}, 3]}',)], "raw string").transform(read_answers)
    row = frame.first()
    assert (row.topics, row.authors) == (["1", "a", '{"b":null}'], ["2", "3"])
    # in a lambda every mention of an expression is work of its own
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("try_variant_get(") < 100


def test_calls_are_retried_and_asked_again():
    calls, pauses = [], []

    def send(system, user, n):
        calls.append(user)
        if len(calls) < 3:
            raise ModelError("busy", 503)
        return "prose" if len(calls) == 3 else '{"ok": 1}'

    client = RetryingClient("m", send, pauses.append)
    assert complete_json(client, "s", "u") == {"ok": 1}
    assert pauses == [1, 2] and len(calls) == 4
    with pytest.raises(ModelError):
        RetryingClient("m", lambda *a: (_ for _ in ()).throw(ModelError("no", 401)), pauses.append).complete_text("s", "u")
    assert pauses == [1, 2]


def test_objects_in_prose():
    assert object_in('Here: ```json\n{"a": {"b": 1}}``` done {x}') == {"a": {"b": 1}}
    for text in ("nothing", '{"a": 1', "{x}"):
        with pytest.raises(ValueError):
            object_in(text)


def test_rule_client_finds_names_and_numbers(spark):
    client = RuleClient({"materials": ["медь"], "processes": ["обжиг"]})
    found = read(spark, complete_json(client, "", "Document: x\n\nОбжиг дал извлечение = 95,5 % и медь"))[0]
    assert [m["name"] for m in found["materials"]] == ["медь"] and found["measurements"][0]["value"] == 95.5


def in_order(rows):
    """(label, key) of the nodes created when mentions are taken one by one."""
    taken, created = set(), set()
    for label, name, english, _ in sorted(rows, key=lambda r: r[3]):
        forms = [f.lower() for f in (name, english) if f]
        if forms and taken.isdisjoint((label, f) for f in forms):
            created.add((label, f"{label[0]}:{forms[0]}"))
            taken.update((label, f) for f in forms)
    return created


MENTIONED = "label string, name string, name_en string, position int"


def created_from(spark, rows, **more):
    got = new_entities(spark.createDataFrame(rows, MENTIONED), **more).collect()
    assert len({(r["label"], r["variant"]) for r in got}) == len(got)
    return {(r["label"], r["key"]) for r in got}


def test_new_names_follow_the_order_of_mentions(spark):
    rows = [("Process", "x", "y", 1), ("Process", "y", "z", 2), ("Process", "z", None, 3), ("Process", "X", None, 4), ("Material", "x", None, 5),
            ("Material", None, "q", 6), ("Material", "", "", 7), ("Material", None, None, 8), ("Material", "Q", "r", 9)]
    for rounds in (0, 1, 3):
        assert created_from(spark, rows, rounds=rounds) == in_order(rows)
    assert created_from(spark, []) == set()


def test_long_chains_of_names_take_few_rounds(spark, monkeypatch):
    from lodegraph.operators import components

    tables = []
    monkeypatch.setattr(components, "written", lambda df, plain=components.written: tables.append(1) or plain(df))
    rows = [("Process", f"n{i}", f"n{i + 1}", i) for i in range(10_000)] + [("Material", f"n{i}", f"n{i // 2}", i + 20_000) for i in range(300)]
    assert created_from(spark, rows) == in_order(rows)
    # four tables a round: some ten rounds for ten thousand links
    assert len(tables) < 4 * 14


def test_names_at_random_follow_the_order_of_mentions(spark):
    dice = random.Random(5)
    rows = [(dice.choice(["Process", "Material"]), f"v{dice.randrange(60)}", dice.choice([None, f"v{dice.randrange(60)}"]), i) for i in range(150)]
    for rounds in (0, 2):
        assert created_from(spark, rows, rounds=rounds) == in_order(rows)
