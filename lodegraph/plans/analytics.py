"""Corpus analytics: coverage, risks, statistics, experts, cards, neighbourhoods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.text import short_label
from lodegraph.graph import CARD_LABELS, ENTITY_LABELS, Graph, column_or_null, is_verified, key_is
from lodegraph.operators.pairs import coverage, gaps
from lodegraph.operators.topn import top_per_group, top_rows
from lodegraph.operators.traversal import comention_counts, mentioned, neighbours
from lodegraph.session import cut_lineage, side, written


def verified(graph: Graph, label: str) -> DataFrame:
    """(key, name) of a label's verified nodes."""
    return graph.entities([label]).where(is_verified()).select("key", "name")


def pair_counts(graph: Graph, left: str = "Material", right: str = "Process") -> DataFrame:
    return comention_counts(graph.mentions(), verified(graph, left), verified(graph, right), left, right)


def _left_named(graph: Graph, label: str) -> DataFrame:
    """(key, material) of a label's verified nodes, one row for each pair of rows that share a key."""
    known = verified(graph, label)
    return known.select("key").join(known.select("key", F.col("name").alias("material")), "key")


def _right_named(pairs: DataFrame, graph: Graph, label: str) -> DataFrame:
    """Adds the name of the other side: few keys, so pairs are not dealt by them."""
    names = verified(graph, label).select(F.col("key").alias("right_key"), F.col("name").alias("process"))
    return pairs.join(side(names), "right_key").withColumnsRenamed({"left_key": "material_key", "right_key": "process_key"})


def gap_matrix(graph: Graph, left: str = "Material", right: str = "Process") -> DataFrame:
    """(material_key, material, process_key, process, docs), zeros included."""
    cells = coverage(_left_named(graph, left), verified(graph, right), pair_counts(graph, left, right))
    return _right_named(cells, graph, right).select("process_key", "material_key", "docs", "material", "process")


def knowledge_gaps(graph: Graph, left: str = "Material", right: str = "Process") -> DataFrame:
    """Verified pairs without a single document mentioning both."""
    missing = gaps(_left_named(graph, left), verified(graph, right), pair_counts(graph, left, right))
    return _right_named(missing, graph, right).select("process_key", "material_key", "material", "process")


def gap_pivot(graph: Graph, rows: int = 20, columns: int = 20) -> DataFrame:
    """(row_no, material_key, material, processes[], cells[]) of the most covered.

    An entity's total is the number of entities of the other label over its
    documents, so no pair is counted to choose rows and columns; only the
    pairs of the chosen ones are.
    """
    mentions, known_m, known_p = graph.mentions(), verified(graph, "Material"), verified(graph, "Process")
    of_material = mentioned(mentions, "Material", known_m, "key")
    of_process = mentioned(mentions, "Process", known_p, "key")

    def busiest(known: DataFrame, own: DataFrame, other: DataFrame, n: int, rank: str) -> DataFrame:
        others = other.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
        totals = own.join(others, "doc_id").groupBy("key").agg(F.sum("n").alias("total"))
        return top_rows(
            known.join(totals, "key", "left").withColumn("total", F.coalesce("total", F.lit(0))),
            [F.col("total").desc(), F.col("key").asc()], n, rank,
        )

    # both lists are request parameters long; each is read twice below
    materials = cut_lineage(busiest(known_m, of_material, of_process, rows, "row_no").select(
        F.col("key").alias("left_key"), F.col("name").alias("material"), "row_no"))
    processes = cut_lineage(busiest(known_p, of_process, of_material, columns, "column_no").select(
        F.col("key").alias("right_key"), F.col("name").alias("process"), "column_no"))
    header = processes.agg(F.sort_array(F.collect_list(F.struct("column_no", "right_key", "process"))).alias("header"))
    left = of_material.withColumnRenamed("key", "left_key").join(F.broadcast(materials.select("left_key")), "left_key", "left_semi")
    right = of_process.withColumnRenamed("key", "right_key").join(F.broadcast(processes.select("right_key")), "right_key", "left_semi")
    found = (
        left.join(right, "doc_id").groupBy("left_key", "right_key").agg(F.count(F.lit(1)).alias("docs"))
        .groupBy("left_key").agg(F.map_from_entries(F.collect_list(F.struct("right_key", "docs"))).alias("seen"))
    )
    listed = header.first()["header"]
    keys = F.array(*[F.lit(h["right_key"]) for h in listed]).cast("array<string>")
    names = F.array(*[F.lit(h["process"]) for h in listed]).cast("array<string>")
    cell = lambda key: F.coalesce(F.element_at("seen", key), F.lit(0)).cast("long")
    return (
        materials.join(found, "left_key", "left")
        .select("row_no", F.col("left_key").alias("material_key"), "material",
                names.alias("processes"), F.transform(keys, cell).alias("cells"))
        .orderBy("row_no")
    )


def risk_pairs(graph: Graph, most: int = 3, n: int | None = 24) -> DataFrame:
    """Pairs covered by 1 to `most` documents, the weakest first."""
    names = verified(graph, "Material").select(F.col("key").alias("left_key"), F.col("name").alias("material"))
    weak = pair_counts(graph).where(F.col("docs") <= most).join(names, "left_key")
    weak = _right_named(weak, graph, "Process").select("process_key", "material_key", "docs", "material", "process")
    ordered = weak.orderBy("docs", "material", "material_key", "process_key")
    return ordered.limit(n) if n else ordered


def node_counts(graph: Graph) -> DataFrame:
    return graph.all_nodes().groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def edge_counts(graph: Graph) -> DataFrame:
    return graph.all_edges().groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def documents_by_category(graph: Graph) -> DataFrame:
    return graph.node("Document").groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.min("year").alias("year_min"), F.max("year").alias("year_max")
    )


def review_by_label(graph: Graph) -> DataFrame:
    return graph.all_nodes().where("needs_review").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def review_queue(graph: Graph, n: int = 50) -> DataFrame:
    """(label, key, name, confidence) awaiting an expert; n is 1 to 200."""
    if not 1 <= n <= 200:
        raise ValueError("limit must be 1 to 200")
    return (
        graph.all_nodes().where("needs_review")
        .select("label", "key", F.col("title_or_text").alias("name"), "confidence")
        .orderBy("label", F.col("name").asc_nulls_last(), "key").limit(n)
    )


def newly_met(graph: Graph, n: int = 50) -> DataFrame:
    """(label, name, created_at) of nodes first met in texts and not yet reviewed."""
    return (
        graph.all_nodes().where("needs_review").select("label", F.col("name"), "created_at", "key")
        .orderBy("label", F.col("name").asc_nulls_last(), "key").limit(n).drop("key")
    )


def document_sizes(graph: Graph) -> DataFrame:
    """(doc_id, chunks, chars) of every document."""
    return graph.node("Chunk").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text").cast("long")).alias("chars"))


def totals(graph: Graph) -> DataFrame:
    """One row of counts over the whole graph, zero where there is nothing.

    A single pass over the narrow union of all nodes.
    """
    nodes = graph.all_nodes()

    def count(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    return nodes.agg(
        count(F.col("label") == "Document", "documents"),
        count(F.col("label") == "Conclusion", "conclusions"),
        count(F.col("label") == "Measurement", "measurements"),
        count(F.col("label").isin(*ENTITY_LABELS), "entities"),
        count(F.coalesce("needs_review", F.lit(False)), "needs_review"),
        count(F.col("reviewed_at").isNotNull(), "reviewed"),
    )


def verification_progress(graph: Graph) -> DataFrame:
    """Share of reviewed among reviewed and waiting; null when there are none."""
    return totals(graph).select(
        "reviewed", "needs_review",
        F.try_divide(F.col("reviewed"), F.col("reviewed") + F.col("needs_review")).alias("progress"),
    )


def topic_coverage(graph: Graph, n: int | None = None) -> DataFrame:
    """(topic, docs, conclusions, measurements) of all topics, or of the n with most documents.

    Conclusions and measurements are counted per document before they meet
    the topics; joining first would multiply them with each other. Edges are
    unique by their ends, so plain counts are distinct counts.
    """
    conclusions = graph.edge("DESCRIBED_IN").groupBy(F.col("dst_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("c"))
    reports = graph.edge("REPORTS").groupBy(F.col("src_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("m"))
    tagged = graph.edge("TAGGED").select(F.col("src_id").alias("doc_id"), F.col("dst_id").alias("topic"))
    covered = (
        tagged.join(conclusions, "doc_id", "left").join(reports, "doc_id", "left")
        .groupBy("topic").agg(
            F.count(F.lit(1)).alias("docs"),
            F.coalesce(F.sum("c"), F.lit(0)).alias("conclusions"),
            F.coalesce(F.sum("m"), F.lit(0)).alias("measurements"),
        )
        .orderBy(F.col("docs").desc(), "topic")
    )
    return covered if n is None else covered.limit(n)


def top_experts(graph: Graph, n: int = 12) -> DataFrame:
    """(name, docs) of the most prolific authors."""
    people = graph.node("Person").select(F.col("id").alias("dst_id"), "name")
    # persons sharing a name count together, a common document once
    return (
        graph.edge("AUTHORED_BY").select("src_id", "dst_id").join(people, "dst_id")
        .groupBy("name").agg(F.count_distinct("src_id").alias("docs"))
        .orderBy(F.col("docs").desc(), "name").limit(n)
    )


def dashboard(graph: Graph, topics: int = 20) -> dict[str, DataFrame]:
    return {
        "totals": totals(graph),
        "coverage": topic_coverage(graph, topics),
        "risk_pairs": risk_pairs(graph),
        "review_by_label": review_by_label(graph),
        "experts": top_experts(graph),
    }


# --- cards and neighbourhoods -------------------------------------------------


def entity_documents(graph: Graph, label: str, key: str, n: int = 25) -> DataFrame:
    """Documents mentioning an entity most: (id, title, category, year, mentions)."""
    node = graph.node(label, CARD_LABELS)
    wanted = node.where(key_is(node, key)).select(F.col("id" if "id" in node.columns else "name").alias("dst_id"))
    counted = graph.mentions(label).join(wanted, "dst_id", "left_semi").select(
        F.col("src_id").alias("id"), F.col("count").alias("mentions"))
    best = top_rows(counted, [F.col("mentions").desc(), F.col("id").asc()], n)
    docs = graph.node("Document")
    return docs.select("id", "title", "category", column_or_null(docs, "year", "int").alias("year")).join(
        F.broadcast(best), "id").orderBy("rank")


def entity_conclusions(graph: Graph, label: str, key: str, n: int = 25) -> DataFrame:
    """(text, confidence, geography, doc) about an entity, distinct."""
    node = graph.node(label, CARD_LABELS)
    wanted = node.where(key_is(node, key)).select(F.col("id" if "id" in node.columns else "name").alias("dst_id"))
    about = graph.edge("ABOUT").where(F.col("dst_label") == label).join(wanted, "dst_id", "left_semi").select(
        F.col("src_id").alias("id"))
    conclusions = graph.node("Conclusion").join(about, "id", "left_semi")
    described = graph.edge("DESCRIBED_IN").select(F.col("src_id").alias("id"), F.col("dst_id").alias("doc_id"))
    titles = graph.node("Document").select(F.col("id").alias("doc_id"), F.col("title").alias("doc"))
    return (
        conclusions.join(described, "id", "left").join(titles, "doc_id", "left")
        .select("text", "confidence", "geography", "doc").distinct()
        .orderBy(F.col("confidence").desc_nulls_last(), "text", F.col("doc").asc_nulls_last()).limit(n)
    )


def entity_card(graph: Graph, label: str, key: str) -> dict[str, DataFrame]:
    node = graph.node(label, CARD_LABELS)
    return {
        "props": node.where(key_is(node, key)),
        "docs": entity_documents(graph, label, key),
        "conclusions": entity_conclusions(graph, label, key),
    }


def chunk_context(graph: Graph, chunk_id: str | None = None, width: int = 2) -> DataFrame:
    """A chunk with its neighbours and the document's title (all chunks if no id)."""
    chunks = graph.node("Chunk").select("id", "doc_id", "seq", "unit_kind", "unit_no", "text")
    focus = chunks.where(F.col("id") == chunk_id) if chunk_id is not None else chunks
    docs = graph.node("Document")
    titles = docs.select(F.col("id").alias("doc_id"), "title", "category", column_or_null(docs, "rel_path").alias("rel_path"))
    return neighbours(chunks, focus.select("id", "doc_id", "seq"), width).join(titles, "doc_id").orderBy("focus_id", "seq")


def conclusion_history(graph: Graph, conclusion_id: str) -> DataFrame:
    """The current state and the archived versions, oldest first, as an array."""
    versions = graph.node("ConclusionVersion").where(F.col("conclusion_id") == conclusion_id)
    item = F.struct("version", "text", "confidence", "geography", "archived_at", "archived_by_model")
    history = versions.groupBy(F.col("conclusion_id").alias("id")).agg(F.sort_array(F.collect_list(item)).alias("history"))
    current = graph.node("Conclusion").where(F.col("id") == conclusion_id).select(
        "id", "text", "confidence", "geography", F.coalesce("version", F.lit(1)).alias("version"), "updated_at", "needs_review")
    empty = F.array().cast(history.schema["history"].dataType)
    return current.join(history, "id", "left").withColumn("history", F.coalesce("history", empty))


def node_payload(nodes: DataFrame) -> DataFrame:
    """(node_id, label, name, needs_review) as a graph view shows a node."""
    return nodes.select(
        F.concat("label", F.lit(":"), "key").alias("node_id"), "label",
        short_label("shown").alias("name"), F.coalesce("needs_review", F.lit(False)).alias("needs_review"),
    )


def edges_around_document(graph: Graph, doc_id: str, n: int = 30) -> DataFrame:
    """(from_id, to_id, type, weight): its top mentions and its conclusions."""
    counted = graph.mentions().where(F.col("src_id") == doc_id)
    best = top_rows(counted, [F.col("count").desc(), F.col("dst_label").asc(), F.col("dst_id").asc()], n)
    me = F.lit(f"Document:{doc_id}")
    mentions = best.select(me.alias("from_id"), F.concat("dst_label", F.lit(":"), "dst_id").alias("to_id"),
                           F.lit("MENTIONS").alias("type"), F.col("count").cast("long").alias("weight"))
    described = graph.edge("DESCRIBED_IN").where(F.col("dst_id") == doc_id).select(
        F.concat(F.lit("Conclusion:"), "src_id").alias("from_id"), me.alias("to_id"),
        F.lit("DESCRIBED_IN").alias("type"), F.lit(1).cast("long").alias("weight")).distinct()
    return mentions.unionByName(described)


def edges_around_entity(graph: Graph, label: str, key: str, docs: int = 15, others: int = 8,
                        allowed_categories: Sequence[str] | None = None) -> DataFrame:
    """(from_id, to_id, type, weight): an entity's top documents and their top others.

    A restricted reader's documents are filtered before the cut, so the view
    stays full for them.
    """
    node = graph.node(label, ENTITY_LABELS)
    wanted = node.where(key_is(node, key)).select(F.col("id" if "id" in node.columns else "name").alias("dst_id"))
    near = graph.mentions(label).join(wanted, "dst_id", "left_semi")
    if allowed_categories is not None:
        visible = graph.node("Document").where(F.col("category").isin(list(allowed_categories)))
        near = near.join(visible.select(F.col("id").alias("src_id")), "src_id", "left_semi")
    best = top_rows(near.select("src_id", F.col("dst_id").alias("me"), "count"),
                    [F.col("count").desc(), F.col("src_id").asc(), F.col("me").asc()], docs)
    centre = best.select(F.concat(F.lit("Document:"), "src_id").alias("from_id"),
                         F.concat(F.lit(f"{label}:"), "me").alias("to_id"),
                         F.lit("MENTIONS").alias("type"), F.lit(1).cast("long").alias("weight"))
    around = (
        graph.mentions().join(F.broadcast(best.select("src_id", "me")), "src_id")
        .where(~((F.col("dst_label") == label) & (F.col("dst_id") == F.col("me"))))
    )
    top = top_per_group(around, ["me", "src_id"],
                        [F.col("count").desc(), F.col("dst_label").asc(), F.col("dst_id").asc()], others)
    far = top.select(F.concat(F.lit("Document:"), "src_id").alias("from_id"),
                     F.concat("dst_label", F.lit(":"), "dst_id").alias("to_id"),
                     F.lit("MENTIONS").alias("type"), F.col("count").cast("long").alias("weight"))
    return centre.unionByName(far)


def graph_view(graph: Graph, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node payloads and edges of one bounded neighbourhood."""
    ids = edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct().select(
        F.substring_index("id", ":", 1).alias("label"),
        F.regexp_replace("id", "^[^:]*:", "").alias("key"))
    return node_payload(graph.all_nodes().join(F.broadcast(ids), ["label", "key"], "left_semi")), edges


# --- the set of ready-made analytic questions ---------------------------------


def comention_documents(graph: Graph, material: str, process: str) -> DataFrame:
    """(doc_id, title, category, year, language, equipment[]) mentioning both."""
    def holding(label: str, key: str) -> DataFrame:
        node = graph.node(label)
        wanted = node.where(key_is(node, key)).select(F.col("id" if "id" in node.columns else "name").alias("dst_id"))
        return graph.mentions(label).join(wanted, "dst_id", "left_semi").select(F.col("src_id").alias("id"))

    docs = graph.node("Document")
    chosen = (
        docs.select("id", "title", "category", "year", column_or_null(docs, "language").alias("language"))
        .join(holding("Material", material), "id", "left_semi").join(holding("Process", process), "id", "left_semi")
    )
    names = graph.node("Equipment").select(F.col("id").alias("dst_id"), F.col("name").alias("equipment"))
    beside = graph.mentions("Equipment").select(F.col("src_id").alias("id"), "dst_id").join(names, "dst_id")
    return (
        chosen.join(beside, "id", "left").groupBy("id", "title", "category", "year", "language")
        .agg(F.sort_array(F.collect_set("equipment")).alias("equipment"))
        .orderBy(F.col("year").desc_nulls_first(), "id")
    )


def conclusions_about(graph: Graph, processes: Sequence[str]) -> DataFrame:
    """(process, text, confidence, geography, title, fragment), surest first."""
    wanted = graph.node("Process").where(F.col("name").isin(list(processes))).select(
        F.col("id").alias("dst_id"), F.col("name").alias("process"))
    about = graph.edge("ABOUT").where(F.col("dst_label") == "Process").join(wanted, "dst_id").select(
        F.col("src_id").alias("id"), "process")
    described = graph.edge("DESCRIBED_IN").select(F.col("src_id").alias("id"), F.col("dst_id").alias("doc_id"), "fragment")
    titles = graph.node("Document").select(F.col("id").alias("doc_id"), "title")
    return (
        graph.node("Conclusion").select("id", "text", "confidence", "geography")
        .join(about, "id").join(described, "id").join(titles, "doc_id")
        .select("process", "id", "text", "confidence", "geography", "title", "fragment")
        .orderBy("process", F.col("confidence").desc_nulls_first(), "id")
    )


def measurement_report(graph: Graph) -> DataFrame:
    """Every measurement with its property, document and place."""
    # few properties have most measurements: dealt by property, these would meet in a few tasks
    properties = side(written(graph.node("Property").select(F.col("name").alias("property")).distinct()))
    titles = graph.node("Document").select(F.col("id").alias("doc_id"), "title")
    found = graph.node("Measurement").select("doc_id", "property", "value", "value_max", "unit", "conditions", "place")
    return found.join(properties, "property", "left_semi").join(titles, "doc_id")


def corpus_overview(graph: Graph, language: str = "en") -> DataFrame:
    return (
        graph.node("Document").groupBy("category").agg(
            F.count(F.lit(1)).alias("docs"), F.min("year").alias("year_from"), F.max("year").alias("year_to"),
            F.count_if(F.col("language") == language).alias("in_language"),
        ).orderBy(F.col("docs").desc(), F.col("category").asc_nulls_last())
    )


def experts_by_process(graph: Graph, process: str, titles: int = 5) -> DataFrame:
    """(author, docs, titles[]) of the documents mentioning a process."""
    node = graph.node("Process")
    wanted = node.where(key_is(node, process)).select(F.col("id").alias("dst_id"))
    docs = graph.mentions("Process").join(wanted, "dst_id", "left_semi").select(F.col("src_id").alias("doc_id")).distinct()
    named = graph.node("Document").select(F.col("id").alias("doc_id"), "title")
    written = (
        graph.edge("AUTHORED_BY").select(F.col("src_id").alias("doc_id"), "dst_id")
        .join(docs, "doc_id", "left_semi").join(named, "doc_id")
    )
    # the count needs every document, the list only its first titles
    counts = written.groupBy("dst_id").agg(F.count(F.lit(1)).alias("docs"))
    first = top_per_group(written.select("dst_id", "title").distinct(), ["dst_id"], [F.col("title").asc()], titles)
    lists = first.groupBy("dst_id").agg(F.sort_array(F.collect_list("title")).alias("titles"))
    people = graph.node("Person").select(F.col("id").alias("dst_id"), F.col("name").alias("author"))
    return counts.join(lists, "dst_id").join(people, "dst_id").select("author", "docs", "titles") \
        .orderBy(F.col("docs").desc(), "author")
