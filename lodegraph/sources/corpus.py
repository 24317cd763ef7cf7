"""Document corpus: a folder tree of files to documents, chunks and authors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.chunking import numbered, pieces_of
from lodegraph.functions.ids import document_id, person_id
from lodegraph.functions.text import clean_title, detect_language, find_year, strip
from lodegraph.sinks import upsert
from lodegraph.sinks.store import Store
from lodegraph.sources import units as U

# --- fixed values: the folder layout of the corpus ----------------------------
ROOT_FOLDER = "Источники информации"
CATEGORY_BY_FOLDER = {
    "Доклады": "доклад",
    "Журналы": "журнальная статья",
    "Материалы конференций": "материалы конференции",
    "Обзоры": "обзор",
    "Статьи": "статья",
}
JOURNALS, CONFERENCES = "Журналы", "Материалы конференций"
REPORT_AUTHOR = r"(?iu)^Доклад_(.+?)\.(pdf|docx|pptx|docm|xlsx?|xlsm)$"
# -----------------------------------------------------------------------------


def corpus_root(store: Store, root: str) -> str:
    """The sources folder below `root`, at most one level deeper; else `root`."""
    root = root.rstrip("/")
    if ROOT_FOLDER in store._children(root):
        return f"{root}/{ROOT_FOLDER}"
    for child in sorted(store._children(root)):
        if ROOT_FOLDER in store._children(f"{root}/{child}"):
            return f"{root}/{child}/{ROOT_FOLDER}"
    return root


def path_columns(rel_path: Column) -> dict[str, Column]:
    """Everything the path of a file tells about the document."""
    parts = F.split(rel_path, "/")
    top, depth, name = F.element_at(parts, 1), F.size(parts), F.element_at(parts, -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    part = lambda i: F.try_element_at(parts, F.lit(i))
    years_below = F.concat_ws("\n", F.slice(parts, 2, F.greatest(depth - 1, F.lit(1))))
    category = F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORY_BY_FOLDER.items() for x in kv]), top)
    author = F.nullif(strip(F.translate(F.regexp_extract(name, REPORT_AUTHOR, 1), "_", " ")), F.lit(""))
    return {
        "doc_id": document_id(rel_path),
        "category": category,
        "journal": F.when((top == JOURNALS) & (depth >= 3), part(2)),
        "conference": F.when((top == CONFERENCES) & (depth >= 3), part(2)),
        # a journal's year is that of its third folder, a conference's the
        # first one found below the top, anything else's that of its name
        "year": F.when((top == JOURNALS) & (depth >= 3), find_year(part(3)))
        .when(top == CONFERENCES, find_year(years_below)).otherwise(find_year(stem)),
        "stem": stem,
        "suffix": F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)),
        "author": author,
    }


def scan(spark: SparkSession, root: str, extra_suffixes: tuple[str, ...] = ()) -> DataFrame:
    """One row per supported file, content included but only read when used."""
    wanted = (*U.DOCUMENT_SUFFIXES, *U.IMAGE_SUFFIXES, *extra_suffixes)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/") + "/"), "^[a-z0-9]+:/*", "/")
    plain = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    rel = F.substring(plain, F.length(base) + 1, F.length(plain))
    rows = files.withColumn("rel_path", F.try_url_decode(F.replace(rel, F.lit("+"), F.lit("%2B"))))
    rows = rows.withColumn("rel_path", F.coalesce("rel_path", rel))
    return (
        rows.withColumns(path_columns(F.col("rel_path")))
        .where(F.col("suffix").isin(*wanted) & F.col("category").isNotNull())
        .select("doc_id", "rel_path", "category", "journal", "conference", "year", "stem", "suffix", "author", "length", "content")
    )


PARSED = ("doc_id string, title string, unit_no int, unit_kind string, text string, chars bigint, "
          "pieces array<string>, error string")


def parse(files: DataFrame, options: U.Options = U.Options()) -> DataFrame:
    """One row per unit (or one row with `error`), already cut into chunks.

    A file is read, split and chunked by the task that holds it: no shuffle
    carries text.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, suffix, content in zip(batch["doc_id"], batch["suffix"], batch["content"]):
                title, error, found = U.file_title(suffix, content), None, []
                try:
                    found = U.file_units(suffix, content, options)
                    error = None if found else "no text found"
                except U.Unreadable as problem:
                    error = str(problem)
                rows = [(doc_id, title, no, kind, text, len(text), pieces_of(text), None) for no, kind, text in found]
                yield pd.DataFrame(
                    rows or [(doc_id, title, None, None, None, None, None, error)],
                    columns=["doc_id", "title", "unit_no", "unit_kind", "text", "chars", "pieces", "error"])

    return files.select("doc_id", "suffix", "content").mapInPandas(run, PARSED)


@dataclass
class Corpus:
    documents: DataFrame
    chunks: DataFrame
    people: DataFrame
    authorship: DataFrame
    rejected: DataFrame


def plan(files: DataFrame, parsed: DataFrame, loaded_at: str) -> Corpus:
    """Documents, chunks and authors from scanned and parsed files.

    `parsed` should be a written table: it is read several times.
    """
    meta = files.drop("content", "length")
    good = parsed.where("error is null")
    # per document only sizes and the first unit's language are gathered
    facts = good.select("doc_id", "unit_no", "title", "chars", detect_language("text").alias("language")).groupBy("doc_id").agg(
        F.first("title", ignorenulls=True).alias("title"), F.min_by("language", "unit_no").alias("language"),
        F.count(F.lit(1)).cast("int").alias("units"), F.sum("chars").alias("chars"))
    documents = meta.join(facts, "doc_id").select(
        F.col("doc_id").alias("id"), F.coalesce(clean_title("title"), "stem").alias("title"), "category",
        F.col("category").alias("doc_type"), "journal", "conference", "year", "language", "rel_path", "units", "chars")
    chunks = numbered(good.select("doc_id", "unit_no", "unit_kind", "pieces"))
    written = meta.where(F.col("author").isNotNull()).join(facts.select("doc_id"), "doc_id", "left_semi")
    prov = F.concat(F.regexp_extract("rel_path", "([^/]*)$", 1), F.lit("#"), "doc_id")
    return Corpus(
        documents, chunks,
        written.select(person_id("author").alias("id"), F.col("author").alias("name")).dropDuplicates(["id"]),
        written.select(F.col("doc_id").alias("src_id"), person_id("author").alias("dst_id"), prov.alias("source"),
                       F.lit(1.0).alias("confidence"), F.lit(loaded_at).alias("loaded_at")),
        parsed.where("error is not null").join(meta.select("doc_id", "rel_path"), "doc_id").select(
            F.col("rel_path").alias("record"), F.col("error").alias("reason")),
    )


def ingest(store: Store, root: str, loaded_at: str, category: str | None = None, resume: bool = False,
           limit: int | None = None, options: U.Options = U.Options(), work: str | None = None) -> Corpus:
    """Loads the corpus below `root` into the store.

    Parsed units are written once under `work` (next to the store by default)
    and everything else is derived from that table.
    """
    files = scan(store.spark, corpus_root(store, root), tuple(options.extra))
    if category:
        files = files.where(F.col("category") == category)
    if resume:
        files = upsert.without(files, store.read("Document").select(F.col("id").alias("doc_id")), "doc_id")
    if limit:
        chosen = files.select("doc_id", "rel_path").orderBy("rel_path").limit(limit)
        files = files.join(chosen.select("doc_id"), "doc_id", "left_semi")
    taken = [int(c[4:]) for c in store._children(work or f"{store.root}/_parsed") if c.startswith("run=")]
    target = f"{work or store.root + '/_parsed'}/run={max(taken, default=0) + 1}"
    parse(files, options).write.parquet(target)
    corpus = plan(files, store.spark.read.parquet(target), loaded_at)
    store.merge_nodes("Document", corpus.documents)
    store.merge_chunks(corpus.chunks)
    store.create_nodes("Person", corpus.people)
    store.merge_edges("AUTHORED_BY", corpus.authorship)
    return corpus
