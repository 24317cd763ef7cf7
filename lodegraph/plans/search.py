"""Hybrid retrieval: vector, full-text, graph and measurement channels."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.text import display_title, signature
from lodegraph.functions.vectors import Encoder
from lodegraph.graph import Graph, column_or_null
from lodegraph.operators.fulltext import search_texts
from lodegraph.operators.fusion import RRF_K, channel, diversify, fetch_size, fuse
from lodegraph.operators.resolve import resolve_question
from lodegraph.operators.similarity import nearest
from lodegraph.operators.topn import top_rows
from lodegraph.operators.traversal import document_entities, entities_array, graph_candidates
from lodegraph.session import cut_lineage, written

DOCUMENT_COLUMNS = ("title", "category", "journal", "conference", "language", "rel_path")


def document_filter(documents: DataFrame, category: str | None = None, language: str | None = None,
                    year_from: int | None = None, year_to: int | None = None,
                    allowed_categories: Sequence[str] | None = None) -> DataFrame:
    """Conjunction of the filters that are set; a null column fails its test."""
    if category is not None:
        documents = documents.where(F.col("category") == category)
    if allowed_categories is not None:
        documents = documents.where(F.col("category").isin(list(allowed_categories)))
    if language is not None:
        documents = documents.where(F.col("language") == language)
    if year_from is not None:
        documents = documents.where(F.col("year") >= year_from)
    if year_to is not None:
        documents = documents.where(F.col("year") <= year_to)
    return documents


def check_request(query: str, k: int, k_max: int, language: str | None = None,
                  year_from: int | None = None, year_to: int | None = None) -> None:
    """Bounds of a search request; raises ValueError."""
    if not 2 <= len(query) <= 1000:
        raise ValueError("query must have 2 to 1000 characters")
    if not 1 <= k <= k_max:
        raise ValueError(f"k must be 1 to {k_max}")
    if language not in (None, "ru", "en"):
        raise ValueError("language must be ru or en")
    for year in (year_from, year_to):
        if year is not None and not 1900 <= year <= 2100:
            raise ValueError("years must be 1900 to 2100")
    if year_from is not None and year_to is not None and year_from > year_to:
        raise ValueError("year_from is after year_to")


def _documents(graph: Graph) -> DataFrame:
    docs = graph.node("Document")
    return docs.select(
        F.col("id").cast("string").alias("doc_id"),
        *[column_or_null(docs, c).alias(c) for c in DOCUMENT_COLUMNS],
        column_or_null(docs, "year", "int").alias("year"),
    )


# a channel: (size, within) -> (chunk_id, rank), or such a frame
Ranked = DataFrame | Callable[[int, DataFrame | None], DataFrame]


def _ranked(source: Ranked, size: int, within: DataFrame | None) -> DataFrame:
    if not isinstance(source, DataFrame):
        return source(size, within)
    if within is not None:
        source = source.join(within, "chunk_id", "left_semi")
    return top_rows(source.select("chunk_id", F.col("rank").alias("_given")), [F.col("_given").asc(), F.col("chunk_id").asc()], size)


def hybrid_search(graph: Graph, query: str, vector: Sequence[float] | None = None, k: int = 10,
                  category: str | None = None, language: str | None = None,
                  year_from: int | None = None, year_to: int | None = None, rrf_k: int = RRF_K,
                  entity_keys: Sequence[str] | None = None, measured: Ranked | None = None,
                  allowed_categories: Sequence[str] | None = None, encoder: Encoder | None = None,
                  fulltext: Ranked | None = None, vectors: Ranked | None = None,
                  lookup: bool = False) -> DataFrame:
    """The k best chunks for a query, one row each, ordered by `place`.

    Filters act before every channel's cut, so hidden documents take no place
    of visible ones; scores are those of the whole collection all the same.
    `measured` adds a channel and `fulltext` replaces the text scan (by a
    stored index, say): each is a function of (size, within) that ranks chunks
    of `within` only, or a ready (chunk_id, rank) frame, whose visible rows
    move up. `vectors` names a separate (id, embedding) table where chunks
    carry none, or is such a function over a stored index. With `lookup` the fused ids (a few hundred by construction)
    become a literal filter, so that a stored chunk table is read only where
    its row groups may hold one.
    """
    chunks = graph.node("Chunk")
    documents = document_filter(_documents(graph), category, language, year_from, year_to, allowed_categories)
    filtered = any(x is not None for x in (category, language, year_from, year_to, allowed_categories))
    size = fetch_size(k)
    mentions = graph.mentions("Material", "Process", "Equipment")
    seen, within = chunks, None
    if filtered:
        seen = chunks.join(documents.select("doc_id"), "doc_id", "left_semi")
        # every channel asks for these ids; the texts are not cut anew for each
        within = written(seen.select(F.col("id").alias("chunk_id")))
        mentions = mentions.join(documents.select(F.col("doc_id").alias("src_id")), "src_id", "left_semi")
    if vector is None and encoder is not None:
        vector = encoder([query])[0]
    channels = []
    if vector is not None:
        if callable(vectors):
            found = vectors(size, within)
        else:
            vectors = graph.chunk_vectors() if vectors is None else vectors
            if filtered:
                vectors = vectors.join(within.withColumnRenamed("chunk_id", "id"), "id", "left_semi")
            found = nearest(vectors, vector, size)
        channels.append(channel(found, "vector"))
    if fulltext is None:
        fulltext = lambda n, among: search_texts(chunks, query, n, within=among)
    channels.append(channel(_ranked(fulltext, size, within), "fulltext"))
    if entity_keys:
        channels.append(channel(graph_candidates(mentions, entity_keys, size), "graph"))
    if measured is not None:
        channels.append(channel(_ranked(measured, size, within), "measure"))
    fused = fuse(channels, rrf_k)
    found = chunks
    if lookup:
        rows = fused.collect()
        fused = chunks.sparkSession.createDataFrame(rows, fused.schema)
        found = chunks.where(F.col("id").isin([r["chunk_id"] for r in rows]))
    # a few hundred rows by construction, hence the broadcast
    hits = (
        found.select(F.col("id").alias("chunk_id"), "doc_id", "unit_kind", "unit_no", "text")
        .join(F.broadcast(fused), "chunk_id")
        .join(documents, "doc_id")
        .withColumn("signature", signature("text"))
    )
    return (
        diversify(hits, k)
        .withColumn("rrf_score", F.round("rrf_score", 5))
        .withColumn("display_title", display_title("title", "journal", "year"))
        .drop("signature", "position")
        .orderBy("place")
    )


def with_entities(graph: Graph, hits: DataFrame) -> DataFrame:
    """Adds `entities`: the top entities of each hit's document, empty if none."""
    hits = cut_lineage(hits)  # k rows; the search is not run again for each of its two uses
    wanted = hits.select(F.col("doc_id").alias("src_id")).distinct()
    edges = graph.mentions().join(F.broadcast(wanted), "src_id", "left_semi")
    arrays = entities_array(document_entities(edges, graph.entities()))
    empty = F.array().cast("array<struct<label:string,name:string,mentions:bigint>>")
    return hits.join(arrays, "doc_id", "left").withColumn("entities", F.coalesce("entities", empty))


def semantic_search(graph: Graph, vector: Sequence[float], k: int = 8, category: str | None = None,
                    language: str | None = None, year_from: int | None = None,
                    allowed_categories: Sequence[str] | None = None) -> DataFrame:
    """Vector search alone; the filters act before the cut."""
    documents = document_filter(_documents(graph), category, language, year_from, allowed_categories=allowed_categories)
    seen = graph.chunk_vectors()
    if any(x is not None for x in (category, language, year_from, allowed_categories)):
        seen = seen.join(documents.select("doc_id"), "doc_id", "left_semi")
    found = nearest(seen, vector, k)
    chunks = graph.node("Chunk").select(F.col("id").alias("chunk_id"), "doc_id", "unit_kind", "unit_no", "text")
    return (
        chunks.join(F.broadcast(found), "chunk_id").join(documents, "doc_id")
        .orderBy(F.col("score").desc(), F.col("chunk_id").asc()).limit(k)
    )


def fulltext_fragments(graph: Graph, query: str, n: int = 10, chars: int = 200) -> DataFrame:
    """(title, place, fragment, score): the best texts with their beginning, for a result list."""
    found = search_texts(graph.node("Chunk"), query, n)
    chunks = graph.node("Chunk").select(
        F.col("id").alias("chunk_id"), "doc_id", F.concat_ws(" ", "unit_kind", F.col("unit_no").cast("string")).alias("place"),
        F.left("text", F.lit(chars)).alias("fragment"))
    titles = graph.node("Document").select(F.col("id").cast("string").alias("doc_id"), "title")
    return chunks.join(F.broadcast(found), "chunk_id").join(titles, "doc_id").select(
        "title", "place", "fragment", "score", "rank").orderBy("rank")


def question_entities(graph: Graph, question: str) -> list[dict[str, Any]]:
    """Verified entities named in one question; as many as it has words for."""
    return [r.asDict() for r in resolve_question(graph.dictionary(), question).orderBy("label", "key").collect()]


def experts_for_topic(graph: Graph, topic: str, vector: Sequence[float] | None = None, k: int = 25, n: int = 15,
                      titles: int = 5, allowed_categories: Sequence[str] | None = None,
                      encoder: Encoder | None = None, fulltext: Ranked | None = None) -> DataFrame:
    """(name, lab, docs, titles): authors of the documents found for a topic."""
    hits = hybrid_search(graph, topic, vector, k=k, allowed_categories=allowed_categories, encoder=encoder, fulltext=fulltext)
    documents = F.broadcast(hits.select("doc_id", "title").distinct())
    people = graph.node("Person")
    return (
        graph.edge("AUTHORED_BY").join(documents, F.col("src_id") == F.col("doc_id"))
        .join(people.select(F.col("id").alias("dst_id"), "name", column_or_null(people, "lab").alias("lab")), "dst_id")
        .groupBy("name", "lab")
        .agg(F.count_distinct("doc_id").alias("docs"),
             F.slice(F.sort_array(F.collect_set("title")), 1, titles).alias("titles"))
        .orderBy(F.col("docs").desc(), F.col("name").asc(), F.col("lab").asc_nulls_last()).limit(n)
    )
