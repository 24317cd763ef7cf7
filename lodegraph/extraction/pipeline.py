"""From chunks to facts: model calls on executors, then set-based writes."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from lodegraph.extraction.client import EXTRACT_PROMPT, FRAGMENT_TEMPLATE, Client, complete_json
from lodegraph.extraction.schema import read_answers
from lodegraph.functions.ids import person_id
from lodegraph.functions.text import fold, strip
from lodegraph.functions.vectors import Encoder, encode_column
from lodegraph.graph import CANONICAL_LABELS, Graph
from lodegraph.operators.resolve import new_entities, resolve_mentions, variant_lookup
from lodegraph.operators.sampling import stride_sample
from lodegraph.operators.versioning import apply_batch
from lodegraph.session import cut_lineage
from lodegraph.sinks.manifests import children
from lodegraph.sinks.store import Store, conform

# --- fixed values -----------------------------------------------------------
EXTRACTED_CONFIDENCE = 0.8
REVIEW_BELOW = 0.6
UNCLASSIFIED = "не классифицировано"
JOURNAL_CATEGORY = "журнальная статья"
CATEGORY_ORDER = ("обзор", "статья", "доклад", "материалы конференции", "журнальная статья")
# -----------------------------------------------------------------------------
# chunks in a wave of questions, buckets of chunks in a wave of vectors
WAVE, BUCKETS_A_WAVE = 5000, 16


def pending_chunks(graph: Graph, doc_id: str | None = None, category: str | None = None, force: bool = False,
                   chunk_ids: DataFrame | None = None, limit: int | None = None,
                   category_order: Sequence[str] = (), done: DataFrame | None = None) -> DataFrame:
    """Chunks not yet `done` (all of them when forced), with their document."""
    chunks = graph.node("Chunk").select("id", "doc_id", "seq", "unit_kind", "unit_no", "text")
    if not force and done is not None:
        chunks = chunks.join(done.select("id"), "id", "left_anti")
    if doc_id is not None:
        chunks = chunks.where(F.col("doc_id") == doc_id)
    if chunk_ids is not None:
        chunks = chunks.join(chunk_ids.select("id"), "id", "left_semi")
    documents = graph.node("Document").select(F.col("id").alias("doc_id"), "title", "category", "year")
    if category is not None:
        documents = documents.where(F.col("category") == category)
    found = chunks.join(documents, "doc_id")
    if limit is None:
        return found
    priority = F.array_position(F.array(*[F.lit(c) for c in category_order]).cast("array<string>"), F.col("category"))
    return found.orderBy(*([priority] if category_order else []), "doc_id", "seq").limit(limit)


def breadth_sample(graph: Graph, per_document: int = 20, done: DataFrame | None = None,
                   category: str | None = None) -> DataFrame:
    """Ids of evenly spread pending chunks of each document, for a wide first run."""
    pending = pending_chunks(graph, category=category, done=done).select("id", "doc_id", "seq")
    return stride_sample(pending, per_document, F.floor(F.col("seq") / 1000)).select("id")


ANSWERED = "chunk_id string, error string, raw string"


def call_model(chunks: DataFrame, make_client: Callable[[], Client], workers: int = 1,
               partitions: int | None = None) -> DataFrame:
    """One row per chunk: the answer's JSON as it came, or `error`.

    A failing chunk never fails the task. The number of partitions bounds the
    concurrent calls, `workers` those within a task.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()

        def ask(row) -> tuple:
            try:
                year = f", {int(row.year)}" if pd.notna(row.year) and row.year else ""
                prompt = FRAGMENT_TEMPLATE.format(title=row.title, category=row.category, year=year,
                                                  unit_kind=row.unit_kind, unit_no=row.unit_no, text=row.text)
                return row.id, None, json.dumps(complete_json(client, EXTRACT_PROMPT, prompt), ensure_ascii=False)
            except Exception as problem:  # noqa: BLE001
                return row.id, f"{type(problem).__name__}: {problem}", None

        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                yield pd.DataFrame(list(pool.map(ask, batch.itertuples(index=False))), columns=["chunk_id", "error", "raw"])

    spread = chunks.repartition(partitions) if partitions else chunks
    return spread.select("id", "title", "category", "year", "unit_kind", "unit_no", "text").mapInPandas(run, ANSWERED)


def answers_of(answered: DataFrame) -> DataFrame:
    """The answers with their lists in the place of `raw`; `error` also tells what could not be read."""
    read = read_answers(answered)
    # a call that failed has no answer to find fault with
    return read.withColumn("error", F.coalesce("error", "problem")).drop("problem")


@dataclass
class Facts:
    """The row families one run writes."""

    entities: dict[str, DataFrame]
    facilities: DataFrame
    mentions: DataFrame
    topics: DataFrame
    tagged: DataFrame
    people: DataFrame
    authorship: DataFrame
    properties: DataFrame
    measurements: DataFrame
    reports: DataFrame
    conclusions: DataFrame
    described: DataFrame
    about: DataFrame
    done: DataFrame
    rejected: DataFrame


def lookup_of(graph: Graph) -> DataFrame:
    """Every written variant of every canonical node, reviewed or not."""
    frames = []
    for label in CANONICAL_LABELS:
        nodes = graph.node(label)
        name = F.coalesce("name", "grade") if "grade" in nodes.columns else F.col("name")
        frames.append(nodes.select(
            F.lit(label).alias("label"), F.coalesce("id", "name").alias("key"),
            F.array_compact(F.concat(F.array(name), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("variants")))
    return variant_lookup(reduce(DataFrame.unionByName, frames))


def derive(graph: Graph, chunks: DataFrame, answers: DataFrame, model_name: str, now: str,
           review_below: float = REVIEW_BELOW) -> Facts:
    """Row families from stored answers. `answers` has to be a written table:
    it is read many times and a model must not be asked again."""
    place = F.concat_ws(" ", "unit_kind", F.col("unit_no").cast("string"))
    base = (
        answers.where("error is null")
        .join(chunks.select(F.col("id").alias("chunk_id"), "doc_id", "seq", "year", place.alias("unit")), "chunk_id")
    )
    prov = [F.col("chunk_id").alias("source"), "unit", F.lit(EXTRACTED_CONFIDENCE).alias("confidence"),
            F.lit(now).alias("extracted_at"), F.lit(model_name).alias("model")]
    here = ("chunk_id", "doc_id", "seq", "unit")

    def position(kind: int, *parts: Column) -> Column:
        numbers = [F.lit(kind), *parts, *[F.lit(-1)] * (2 - len(parts))]
        return F.struct("doc_id", "seq", *[n.alias(f"p{i}") for i, n in enumerate(numbers)]).alias("position")

    def named(label: str, column: str) -> DataFrame:
        return base.select(*here, F.posexplode(column).alias("i", "m")).select(
            *here, F.lit(label).alias("label"), F.col("m.name").alias("name"), F.col("m.name_en").alias("name_en"),
            F.lit(None).cast("string").alias("conclusion_id"), position(0, F.col("i")))

    concluded = base.select(*here, "year", F.posexplode("conclusions").alias("i", "c")).select(
        *here, "year", "i", F.concat("chunk_id", F.lit(":C"), F.col("i") + 1).alias("id"), "c.*")

    def concerned(label: str, column: str) -> DataFrame:
        return concluded.select(*here, "id", "i", F.posexplode(column).alias("j", "name")).select(
            *here, F.lit(label).alias("label"), "name", F.lit(None).cast("string").alias("name_en"),
            F.col("id").alias("conclusion_id"), position(1, F.col("i"), F.col("j")))

    names = reduce(DataFrame.unionByName, [
        named("Material", "materials"), named("Process", "processes"), named("Equipment", "equipment"),
        concerned("Material", "materials"), concerned("Process", "processes"),
    ])
    first = resolve_mentions(names, lookup_of(graph))
    reserved = new_entities(first.where("key is null"))
    fresh = resolve_mentions(first.where("key is null").drop("key"), reserved.select("label", "variant", "key"))
    resolved = first.where("key is not null").unionByName(fresh)
    created = reserved.dropDuplicates(["label", "key"]).select(
        "label", F.col("key").alias("id"), "name", "name_en", F.array_compact(F.array("name", "name_en")).alias("synonyms"),
        F.lit(True).alias("needs_review"), F.lit(now).alias("created_at"), "position")

    placed = base.select(*here, F.posexplode("facilities").alias("i", "f")).select(*here, "f.*", position(0, F.col("i")))
    mentions = resolved.where("conclusion_id is null").select(
        F.col("doc_id").alias("src_id"), F.col("label").alias("dst_label"), F.col("key").alias("dst_id"), *prov, "position",
    ).unionByName(placed.select(
        F.col("doc_id").alias("src_id"), F.lit("Facility").alias("dst_label"), F.col("name").alias("dst_id"), *prov, "position"))
    topics = base.select(*here, F.explode("topics").alias("t")).select(*here, fold(strip("t")).alias("topic"))
    authors = base.select(*here, F.explode("authors").alias("a")).select(*here, strip("a").alias("name")).where("name <> ''")
    measured = base.select(*here, F.posexplode("measurements").alias("i", "m")).select(
        *here, F.concat("chunk_id", F.lit(":M"), F.col("i") + 1).alias("id"), strip(F.col("m.property")).alias("property"),
        F.col("m.value").alias("value"), F.col("m.value_max").alias("value_max"), F.col("m.unit").alias("value_unit"),
        F.col("m.conditions").alias("conditions"))
    edge = lambda df, src, dst: df.select(F.col(src).alias("src_id"), F.col(dst).alias("dst_id"), *prov)
    return Facts(
        entities={label: created.where(F.col("label") == label).drop("label") for label in CANONICAL_LABELS},
        facilities=placed.select("name", "country", F.lit(True).alias("needs_review"), F.lit(now).alias("created_at"), "position"),
        mentions=mentions,
        topics=topics.select(F.col("topic").alias("name")).distinct(),
        tagged=edge(topics, "doc_id", "topic"),
        people=authors.select(person_id("name").alias("id"), "name", F.lit(True).alias("needs_review")).dropDuplicates(["id"]),
        authorship=edge(authors.withColumn("person", person_id("name")), "doc_id", "person"),
        properties=measured.select(F.col("property").alias("name"), F.lit(UNCLASSIFIED).alias("category"),
                                   F.lit(True).alias("needs_review")).distinct(),
        measurements=measured.select("id", "doc_id", "property", "value", "value_max", F.col("value_unit").alias("unit"),
                                     "conditions", F.col("chunk_id").alias("source"), F.col("unit").alias("place")),
        reports=edge(measured, "doc_id", "id"),
        conclusions=concluded.select(
            "id", "text", "confidence", "geography", F.make_date("year", F.lit(1), F.lit(1)).alias("date"),
            (F.col("confidence") < review_below).alias("needs_review"), F.lit(now).alias("now"), F.lit(model_name).alias("model")),
        described=edge(concluded.drop("confidence"), "id", "doc_id").withColumn("fragment", F.col("unit")),
        about=resolved.where("conclusion_id is not null").select(
            F.col("conclusion_id").alias("src_id"), F.col("label").alias("dst_label"), F.col("key").alias("dst_id"), *prov),
        done=base.select(F.col("chunk_id").alias("id"), F.lit(now).alias("extracted_at")),
        rejected=answers.where("error is not null").select(F.col("chunk_id").alias("record"), F.col("error").alias("reason")),
    )


def save(store: Store, facts: Facts) -> None:
    """Nodes, then edges, the processed marker last: a run that dies is repeated, which changes nothing it had written."""
    for label, rows in facts.entities.items():
        store.create_nodes(label, rows, ["name_en"], "position")
    store.create_nodes("Facility", facts.facilities, ["country"], "position")
    store.create_nodes("TopicTag", facts.topics)
    store.create_nodes("Person", facts.people)
    store.create_nodes("Property", facts.properties)
    store.merge_nodes("Measurement", facts.measurements)
    stored = store.table("Conclusion").lookup(facts.conclusions)
    store.merge_nodes("ConclusionVersion", apply_batch(stored, facts.conclusions)[1])
    store.table("Conclusion").merge(facts.conclusions, lambda old, new: conform(apply_batch(old, new)[0], "Conclusion"))
    store.replace_mentions(facts.mentions, facts.done, "position")
    for kind, rows in (("TAGGED", facts.tagged), ("AUTHORED_BY", facts.authorship), ("REPORTS", facts.reports),
                       ("DESCRIBED_IN", facts.described), ("ABOUT", facts.about)):
        store.merge_edges(kind, rows)
    store.merge_edges("OF_PROPERTY", facts.measurements.select(
        F.col("id").alias("src_id"), F.col("property").alias("dst_id"), "source"))
    store.merge_nodes("ChunkState", facts.done)


class Ledger:
    """Every answer a model has given, by what it was asked; appended wave by wave.

    A wave is a folder that Spark's commit marker completes, so of a run that
    dies only the wave it was in is lost.
    """

    def __init__(self, store: Store):
        self.spark, self.root = store.spark, f"{store.root}/_ledger"

    def _waves(self) -> list[int]:
        found = [int(c[5:]) for c in children(self.spark, self.root) if c.startswith("wave=")]
        return sorted(n for n in found if "_SUCCESS" in children(self.spark, f"{self.root}/wave={n}"))

    def following(self) -> int:
        return max((int(c[5:]) for c in children(self.spark, self.root) if c.startswith("wave=")), default=0) + 1

    def answers(self, since: int = 0) -> DataFrame:
        """(asked, wave, answer columns) of the complete waves from `since` on, read anew from what the model wrote."""
        paths = [f"{self.root}/wave={n}" for n in self._waves() if n >= since]
        schema = f"asked string, wave int, {ANSWERED}"
        return answers_of(self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema))

    def append(self, answers: DataFrame) -> None:
        number = self.following()
        answers.withColumn("wave", F.lit(number)).select("asked", "wave", *[c for c in answers.columns if c != "asked"]) \
            .write.parquet(f"{self.root}/wave={number}")


def asked_of(model_name: str) -> Column:
    """Digest of all a chunk's answer depends on: the prompt, what is filled in and the model."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("title", "category", "year", "unit_kind", "unit_no", "text")]
    return F.sha2(F.concat_ws("\x1f", F.lit(EXTRACT_PROMPT), F.lit(FRAGMENT_TEMPLATE), F.lit(model_name), "id", *parts), 256)


def extract(store: Store, make_client: Callable[[], Client], model_name: str, now: str, workers: int = 1,
            partitions: int | None = None, review_below: float = REVIEW_BELOW, wave: int = WAVE, **selection) -> Facts:
    """Extracts pending chunks into the store, asking the model in waves of about `wave` chunks.

    What the ledger holds an answer to is not asked again, so a run that dies
    costs the wave it was in; failed calls are asked again by the next run.
    With `force` everything is asked anew.
    """
    chunks = pending_chunks(store.graph(), done=store.read("ChunkState"), **selection).withColumn("asked", asked_of(model_name))
    folder = f"{store.root}/_asked"
    number = max((int(c[4:]) for c in store._children(folder)), default=0) + 1
    chunks.write.parquet(f"{folder}/run={number}")
    chunks = store.spark.read.parquet(f"{folder}/run={number}")
    ledger = Ledger(store)
    since = ledger.following() if selection.get("force") else 0
    begun = ledger.following()
    waves = max(1, -(-chunks.count() // wave))
    for k in range(waves):
        known = ledger.answers(since).where("error is null").select("asked")
        todo = chunks.where(F.pmod(F.xxhash64("id"), F.lit(waves)) == k).join(known, "asked", "left_anti")
        answered = call_model(todo, make_client, workers, partitions)
        ledger.append(answered.join(chunks.select(F.col("id").alias("chunk_id"), "asked"), "chunk_id"))
    # the last good answer to each question; failures only of this run
    given = ledger.answers(since).where(F.col("error").isNull() | (F.col("wave") >= begun)).join(chunks.select("asked"), "asked", "left_semi")
    row = F.struct(*[c for c in given.columns if c != "asked"])
    answers = cut_lineage(given.groupBy("asked").agg(F.max_by(row, F.struct(F.col("error").isNull(), "wave")).alias("r")).select("r.*").drop("wave"))
    facts = derive(store.graph(), chunks.drop("asked"), answers, model_name, now, review_below)
    save(store, facts)
    return facts


def embed(store: Store, chunks: DataFrame, make_encoder: Callable[[], Encoder], batch: int = 200) -> int:
    """Gives stored chunks (id, doc_id, digest, text) a vector; texts that have one are left alone."""
    chunks = chunks.select("id", "doc_id", "digest", "text")
    known = store.table("ChunkVector").lookup(chunks).select("id", "digest")
    missing = chunks.join(known, ["id", "digest"], "left_anti")
    encoded = cut_lineage(missing.select("id", "doc_id", "digest", encode_column(make_encoder, batch)("text").alias("embedding")))
    made = encoded.count()
    if made:
        store.merge_vectors(encoded)
    return made


def embed_missing(store: Store, make_encoder: Callable[[], Encoder], limit: int | None = None, batch: int = 200,
                  buckets: int = BUCKETS_A_WAVE) -> int:
    """Gives chunks without a vector one; with a limit journal volumes come last.

    Works through the chunk table some buckets at a time; a run that dies
    keeps the vectors of the buckets before. No text is rewritten.
    """
    if limit is not None:
        documents = store.read("Document").select(F.col("id").alias("doc_id"), "category")
        late = F.coalesce(F.col("category") == JOURNAL_CATEGORY, F.lit(False)).cast("int")
        chosen = store.unembedded().select("id", "doc_id").join(documents, "doc_id", "left").orderBy(late, "id").limit(limit)
        return embed(store, store.read("Chunk").join(chosen.select("id"), "id", "left_semi"), make_encoder, batch)
    found = store.table("Chunk").state()
    parts = sorted(int(b) for b in found[1]["parts"]) if found else []
    return sum(embed(store, store.unembedded(parts[i:i + buckets]), make_encoder, batch) for i in range(0, len(parts), buckets))
