import random
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodegraph.functions import text as T
from lodegraph.functions.chunking import CHUNK_CHARS, OVERLAP_CHARS, chunk_units, pieces_of
from lodegraph.functions.ids import regime_key
from lodegraph.functions.numeric import constraint_bounds, overlaps, parse_numeric
from lodegraph.operators.resolve import resolve_question, resolve_texts


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column.alias("v")).collect()]


ENTITIES = [
    ("Process", "P:1", "электроэкстракция", ["электроэкстракция", "electrowinning"]),
    ("Process", "P:2", "печь взвешенной плавки", ["печь взвешенной плавки", "ПВП"]),
    ("Material", "M:1", "медь", ["медь", "copper"]),
    ("Material", "M:2", "никель", ["никель", "Ni", ""]),
]
QUESTIONS = {
    "режимы электроэкстракции никеля": {"P:1", "M:2"},
    "работа печи взвешенной плавки": {"P:2"},
    "футеровка ПВП": {"P:2"},
    "electrowinning of copper": {"P:1", "M:1"},
    "медленный нагрев": set(),
    "погода в Москве": set(),
}


@pytest.fixture
def dictionary(spark):
    return spark.createDataFrame(ENTITIES, "label string, key string, name string, variants array<string>")


@pytest.mark.parametrize("question,keys", QUESTIONS.items())
def test_question_names_entities(dictionary, question, keys):
    assert {r["key"] for r in resolve_question(dictionary, question).collect()} == keys


def test_many_texts_resolve_like_single_questions(spark, dictionary):
    texts = spark.createDataFrame(list(enumerate(QUESTIONS)), "id int, text string")
    found = {(r["id"], r["key"]) for r in resolve_texts(dictionary, texts).collect()}
    assert found == {(i, k) for i, keys in enumerate(QUESTIONS.values()) for k in keys}


def test_words_of_texts_are_never_broadcast(spark, dictionary, tmp_path):
    spark.createDataFrame(list(enumerate(QUESTIONS)), "id int, text string").write.parquet(f"{tmp_path}/texts")
    texts = spark.read.parquet(f"{tmp_path}/texts")
    plan = resolve_texts(dictionary, texts)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [st#" in plan and "SortMergeJoin [id#" in plan


def test_stems_of_texts_are_those_of_their_words(spark):
    words = ["a", "ab", "abc", "abcd", "abcde", "abcdef", "abcdefg", "Мёд", "медь", "Плавка", "плавки", "x1y2z3", "ß", "naïve"]
    texts = [*words, " ".join(words), "-".join(words), "", None]
    assert values(spark, texts, T.stemmed_words("x")) == values(spark, texts, F.transform(T.tokens("x"), T.stem))


def test_units(spark):
    assert values(spark, ["мг/дм³", "мг / дм3", "мг/л", "% масс", None, "см3"], T.normalize_unit("x")) == \
        ["мг/л", "мг/л", "мг/л", "%", "", "см3"]
    assert values(spark, ["см3"], T.normalize_unit("x", cyrillic_rule=True)) == ["мл"]


def test_intervals(spark):
    inf = float("inf")
    assert constraint_bounds("<", 300) == constraint_bounds("<=", 300) == (-inf, 300)
    assert constraint_bounds(">=", 5) == (5, inf)
    assert constraint_bounds("range", 200, 300) == (200, 300)
    assert constraint_bounds("range", 200) == (200, 200)
    assert constraint_bounds(None, -100) == (-110, -90)
    df = spark.createDataFrame([(1.0, None), (1.0, 5.0), (6.0, 9.0), (None, 4.0)], "v double, m double")
    assert [r[0] for r in df.select(overlaps(F.col("v"), F.col("m"), 4, 7)).collect()] == [False, True, True, False]


def test_query_and_signature(spark):
    assert values(spark, ['SO2 (газ) + "пыль"?'], T.escape_query("x")) == ["SO2  газ" + " " * 5 + "пыль"]
    same = values(spark, ["Один  текст\nдва", " один текст ДВА "], T.signature("x"))
    assert same[0] == same[1]
    assert values(spark, ["я" * 1000], F.length(T.signature("x", T.SIGNATURE_CHARS))) == [420]


def test_names_titles_years(spark):
    assert len(set(values(spark, ["Ti-6Al-4V", "ti 6al 4v", "TI6AL4V", "ti/6al_4v"], T.normalize_name("x")))) == 1
    assert values(spark, ["CM_7_03.qxd", "Обзор"], T.display_title("x", F.lit("Цветные металлы"), F.lit(2003))) == \
        ["Цветные металлы, 2003", "Обзор"]
    assert values(spark, ["CM_7_03.qxd"], T.display_title("x", F.lit(None), F.lit(2003))) == ["CM_7_03.qxd"]
    assert values(spark, ["PO 1901 1987", "2035", None], T.find_year("x")) == [1987, None, None]
    assert values(spark, ["Microsoft Word - Отчёт о плавке.docx", "Document1", "кратко"], T.clean_title("x")) == \
        ["Отчёт о плавке", None, None]
    assert values(spark, ["a" * 90, "short"], T.short_label("x")) == ["a" * 80 + "…", "short"]
    assert values(spark, [" a | |b", None], T.split_list("x")) == [["a", "b"], []]


def test_language(spark):
    assert values(spark, ["Плавка меди", "copper smelting", "123", "медь and other words"], T.detect_language("x")) == \
        ["ru", "en", "unknown", "en"]


WRITTEN = ["60°C", "200-240", "60–65 °C", "-0,25 В", "−5", "около 12,5 %.", "+3", "нет", "", "1.5 - 2 мг/л"]


def test_written_numbers(spark):
    got = [tuple(r) for r in values(spark, WRITTEN, parse_numeric("x"))]
    assert got == [(60, None, "°C"), (200, 240, None), (60, 65, "°C"), (-0.25, None, "В"), (-5, None, None), (12.5, None, "%"), (3, None, None),
                   (None, None, None), (None, None, None), (1.5, 2, "мг/л")]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["", "", "", " ", ". ", "\n"]), max_size=3000), st.integers(20, 200))
def test_pieces_cover_the_text(separators, size):
    """Letters are all different, so every letter of a piece tells its place."""
    text = "".join(chr(0x4E00 + i) + sep for i, sep in enumerate(separators)).strip()
    overlap = size // 8
    pieces = pieces_of(text, size, overlap)
    if len(text) <= size:
        assert pieces == [text]
        return
    reached = 0
    for piece in pieces:
        assert piece == piece.strip() and 0 < len(piece) <= size
        places = [ord(c) - 0x4E00 for c in piece if c >= "\u4e00"]
        if not places:
            continue
        assert places == list(range(places[0], places[-1] + 1))
        assert reached - overlap <= places[0] <= reached
        reached = places[-1] + 1
    assert reached == sum(c >= "\u4e00" for c in text)


def test_chunks_are_numbered_through_units(spark):
    random.seed(1)
    text = lambda n: "".join(random.choice(string.ascii_lowercase + " .") for _ in range(n)).strip()
    rows = [("D1", no, "page", text(900 * no)) for no in range(1, 6)] + [("D2", 1, "page", "one")]
    units = spark.createDataFrame(rows, "doc_id string, unit_no int, unit_kind string, text string")
    got = {(r["doc_id"], r["seq"]): r["text"] for r in chunk_units(units, segment_units=2).collect()}
    want, seq = {("D2", 1): "one"}, 0
    for _, _, _, t in rows[:-1]:
        for piece in pieces_of(t):
            seq += 1
            want["D1", seq] = piece
    assert got == want
    assert CHUNK_CHARS == 1200 and OVERLAP_CHARS == 150


def test_regime_key_ignores_spelling(spark):
    a = '{"type": "отжиг", "temp_min": 750, "temp_max": 800.0, "medium": "вакуум", "params": {"p": 1}}'
    b = '{"medium": " Вакуум", "type": "Отжиг ", "temp_max": 800, "temp_min": 750.0, "params": {"p": 1.0}, "duration_h": null}'
    keys = values(spark, [a, b, a.replace("800", "801")], regime_key(F.col("x")))
    assert keys[0] == keys[1] != keys[2] and len(keys[0]) == 16
