import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lodegraph.extraction.pipeline import embed_missing
from lodegraph.functions.vectors import hashing_encoder
from lodegraph.sources import corpus, units

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def archive(**parts):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return buffer.getvalue()


def docx(paragraphs, rows=(), title=None):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    cells = lambda row: "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in row)
    table = "<w:tbl>" + "".join(f"<w:tr>{cells(r)}</w:tr>" for r in rows) + "</w:tbl>" if rows else ""
    parts = {"word/document.xml": f"<w:document {W}><w:body>{body}{table}</w:body></w:document>"}
    if title:
        parts["docProps/core.xml"] = f'<c xmlns:dc="d"><dc:title>{title}</dc:title></c>'
    return archive(**parts)


def pptx(slides):
    ids = "".join(f'<p:sldId id="{i}" r:id="rId{i}"/>' for i in range(len(slides)))
    rels = "".join(f'<Relationship Id="rId{i}" Target="slides/s{i}.xml"/>' for i in range(len(slides)))
    parts = {
        "ppt/presentation.xml": f"<p:presentation {A} {R}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": f"<Relationships>{rels}</Relationships>",
    }
    for i, text in enumerate(slides):
        shape = f"<p:sp><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>" if text else ""
        parts[f"ppt/slides/s{i}.xml"] = f"<p:sld {A}><p:cSld><p:spTree>{shape}</p:spTree></p:cSld></p:sld>"
    return archive(**parts)


def xlsx(rows):
    def cell(v):
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t>{v}</t></is></c>' if v is not None else "<c/>"

    data = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows)
    return archive(**{
        "xl/workbook.xml": f'<workbook {S} {R}><sheets><sheet name="Состав" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet {S}><sheetData>{data}</sheetData></worksheet>",
    })


def test_sheet_cells():
    found = units.file_units(".xlsx", xlsx([["Металл", "доля"], ["Ni", 95.50], [None, None], ["да?", True], ["n", 2.0]]))
    assert found == [(1, "sheet", "Лист: Состав\nМеталл | доля\nNi | 95.5\nда? | да\nn | 2")]
    cut = units.Options(sheet_rows=1)
    assert units.file_units(".xlsx", xlsx([["a"], ["b"]]), cut) == [(1, "sheet", "Лист: Состав\na")]
    assert units.cell_text(1234567.0) == "1.23457e+06"


def test_word_blocks_and_slides():
    found = units.file_units(".docx", docx([f"p{i}" for i in range(41)], [["a", "", "b"]]))
    assert [u[:2] for u in found] == [(1, "block"), (2, "block")]
    assert found[1][2] == "p40\na | b"
    assert units.file_units(".pptx", pptx(["one", "", "three"])) == [(1, "slide", "one"), (3, "slide", "three")]


def test_unreadable_files():
    for suffix, data in ((".docx", b"junk"), (".txt", b"x"), (".xls", b"x"), (".pdf", b"x")):
        with pytest.raises(units.Unreadable):
            units.file_units(suffix, data)
    # without recognition an image simply has no text; with it, failures are soft
    assert units.file_units(".png", b"x") == []
    assert units.file_units(".png", b"x", units.Options(ocr=lambda _: " seen ")) == [(1, "image", "seen")]
    assert units.file_units(".png", b"x", units.Options(ocr=lambda _: 1 / 0)) == []


FILES = {
    "Статьи/Плавка 2015.docx": docx(["Плавка меди в печи. " * 100, "вторая"], title="Microsoft Word - Плавка меди.docx"),
    "Доклады/Доклад_Иванов_И.И..pptx": pptx(["Доклад о никеле"]),
    "Журналы/Цветные металлы/2003/CM_1.xlsx": xlsx([["Ni", 1]]),
    "Материалы конференций/Минерал 2019/a 2001.docx": docx(["english text only"]),
    "Статьи/broken.docx": b"junk",
    "Прочее/x.docx": docx(["ignored"]),
    "Статьи/notes.txt": b"ignored",
}


@pytest.fixture
def tree(folder):
    for name, data in FILES.items():
        path = f"{folder}/выгрузка/{corpus.ROOT_FOLDER}/{name}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)
    return folder


def test_ingest(store, tree):
    result = corpus.ingest(store, tree, "now")
    docs = {r["rel_path"]: r for r in store.read("Document").collect()}
    assert set(docs) == set(list(FILES)[:4])
    article = docs["Статьи/Плавка 2015.docx"]
    assert (article["title"], article["year"], article["category"], article["language"], article["units"]) == \
        ("Плавка меди", 2015, "статья", "ru", 1)
    journal = docs["Журналы/Цветные металлы/2003/CM_1.xlsx"]
    assert (journal["journal"], journal["year"], journal["title"]) == ("Цветные металлы", 2003, "CM_1")
    paper = docs["Материалы конференций/Минерал 2019/a 2001.docx"]
    assert (paper["conference"], paper["year"], paper["language"]) == ("Минерал 2019", 2019, "en")
    assert [r["record"] for r in result.rejected.collect()] == ["Статьи/broken.docx"]
    assert [r["name"] for r in store.read("Person").collect()] == ["Иванов И.И."]
    chunks = store.read("Chunk").where(F.col("doc_id") == article["id"]).orderBy("seq").collect()
    assert [c["id"] for c in chunks] == [f"{article['id']}:{i}" for i in (1, 2)]
    assert store.graph().edge("HAS_CHUNK").count() == 5


def test_reingest_and_embeddings(store, tree):
    corpus.ingest(store, tree, "now")
    assert embed_missing(store, lambda: hashing_encoder(16), limit=2) == 2
    assert embed_missing(store, lambda: hashing_encoder(16)) == 3
    assert embed_missing(store, lambda: hashing_encoder(16)) == 0
    with open(f"{tree}/выгрузка/{corpus.ROOT_FOLDER}/Доклады/Доклад_Иванов_И.И..pptx", "wb") as f:
        f.write(pptx(["Другой доклад"]))
    corpus.ingest(store, tree, "later", category="доклад")
    stale = store.unembedded().collect()
    assert [c["text"] for c in stale] == ["Другой доклад"]
    assert store.read("Document").count() == 4
    again = corpus.ingest(store, tree, "later", resume=True)
    assert again.documents.count() == 0


def test_readers_can_be_added():
    options = units.Options(extra={".txt": lambda data: iter([(1, "page", data.decode())])})
    assert units.file_units(".TXT", b"one", options) == [(1, "page", "one")]
