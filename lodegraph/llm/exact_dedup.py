"""Exact dedup by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its own content says so, every distinct chunk gets an
identifier that is verified against the chunk's characters, and two texts are
equal exactly when their ordered identifier lists are. Chunks cross the
network once, after each task has folded its own repeats; what is grouped and
joined afterwards are short lists of numbers, never a long document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import rows_left, texts
from lodegraph.session import cut_lineage

SHORTEST, LONGEST = 512, 4096


def chunked(text: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """Chunks of `text` in order; their concatenation is the text.

    A chunk ends before a word that begins with three letters from d to l,
    once it has `shortest` characters, and at `longest` anyway.
    """
    cut = rf"(?s).{{{shortest},{longest - 1}}}?(?:(?<=\s)(?=[d-lD-L]{{3}})|\z)|(?s).{{1,{longest}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    identify: Callable[[Column], Column] = F.xxhash64,
    shortest: int = SHORTEST,
    longest: int = LONGEST,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are compared as they are. The largest doc_id of equal texts stays.

    * null text: equal to the empty text; empty texts form one group;
    * null doc_id: counted in group_size, never kept while its group has an
      id; a group without ids has a null keep_id and nothing kept;
    * repeated rows (same id and text): each is a row of its own, counted
      each, and all are kept if theirs is the largest id;
    * very long texts: any length, their chunks spread over all tasks;
    * empty table: no rows; further columns are ignored.

    `identify` may collide: chunks that share an identifier are told apart by
    a number, which is looked up only for texts that contain such chunks.
    """
    source = texts(docs, doc_id=doc_id, text=text)
    chunks = F.transform(chunked(F.col("text"), shortest, longest), lambda c: F.struct(identify(c).alias("h"), c.alias("chunk")))
    dictionary = source.select(F.explode(chunks).alias("c")).select("c.h", "c.chunk").distinct()
    shared = cut_lineage(dictionary.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("h"))
    rows = cut_lineage(
        source.select(
            "doc_id", F.sha2(F.col("text"), 256).alias("text_sha256"),
            F.transform(chunked(F.col("text"), shortest, longest), lambda c: identify(c)).alias("ids"),
        )
    )
    if shared.isEmpty():
        rows = rows.withColumnRenamed("ids", "recipe")
    else:
        rows = _told_apart(source, dictionary, shared, rows, chunks)
    # stored, so that both sides of the join are shuffled for it and a large group's rows can be split
    found = cut_lineage(rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    return rows.join(found, "recipe").select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256",
    )


def _told_apart(source, dictionary, shared, rows, chunks) -> DataFrame:
    """Recipes of (identifier, number): the number tells chunks with one identifier apart."""
    same = dictionary.join(shared, "h", "left_semi")
    # the digest numbers the chunks of an identifier; the chunk itself is the join key
    numbered = same.select("h", "chunk", F.sha2("chunk", 256).alias("number"))
    pieces = source.select(F.sha2(F.col("text"), 256).alias("text_sha256"), F.posexplode(chunks).alias("at", "c"))
    pieces = pieces.select("text_sha256", "at", "c.h", "c.chunk").join(shared, "h", "left_semi")
    told = (
        pieces.join(numbered, ["h", "chunk"])
        .groupBy("text_sha256", "at").agg(F.min("number").alias("number"))
        .groupBy("text_sha256").agg(F.map_from_entries(F.collect_list(F.struct("at", "number"))).alias("numbers"))
    )
    return rows.join(told, "text_sha256", "left").select(
        "doc_id", "text_sha256",
        F.transform("ids", lambda h, at: F.struct(h.alias("h"), F.col("numbers")[at].alias("number"))).alias("recipe"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """One row of each distinct text, with all its columns: that with the largest doc_id.

    Decisions go back by id and text, so rows that share an id are judged each
    by their own text. Rows that repeat both stay once, as does a text whose
    rows have no id at all; a row without an id goes where another has one.
    """
    found = cut_lineage(groups(docs).select("doc_id", "keep_id", F.col("text_sha256").alias("digest")))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = found.where(~stays).select("doc_id", "digest").distinct()
    again = cut_lineage(found.where(stays).groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return rows_left(docs, F.sha2(F.coalesce("text", F.lit("")), 256), gone, again)


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       coalesce(doc_id = max(doc_id) OVER same, false) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
