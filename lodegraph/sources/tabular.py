"""Structured sources: CSV catalogues, the JSON-lines experiment log, seed lists.

Every loader is a plan that splits its input into node tables, edge tables,
rejected records and warnings. Nothing raises on bad data.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.functions.ids import entity_id, regime_key
from lodegraph.functions.text import normalize_name, split_list, strip
from lodegraph.graph import Graph
from lodegraph.operators.resolve import variant_lookup
from lodegraph.sinks.store import Store


@dataclass
class Load:
    source: str
    loaded: DataFrame
    rejected: DataFrame
    warnings: DataFrame
    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, DataFrame] = field(default_factory=dict)

    def save(self, store: Store) -> None:
        """Nodes first, then the edges whose ends are in place."""
        for label, rows in self.nodes.items():
            store.merge_nodes(label, rows)
        for kind, rows in self.edges.items():
            store.merge_edges(kind, rows)

    def report(self, lines: int | None = None) -> str:
        """Counts of everything, then all rejects and warnings, or the first `lines` of each."""
        out = [f"[{self.source}] loaded: {self.loaded.count()}"]
        for title, df in (("rejected", self.rejected), ("warnings", self.warnings)):
            n = df.count()
            if n:
                out.append(f"  {title}: {n}")
                shown = df.orderBy("record", "reason")
                out += [f"    - {r['record']}: {r['reason']}" for r in (shown if lines is None else shown.limit(lines)).toLocalIterator()]
        return "\n".join(out)


def _issues(df: DataFrame, record: Column, reason: Column) -> DataFrame:
    return df.select(record.cast("string").alias("record"), reason.alias("reason"))


def _file_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def provenance(path: str, record: Column, loaded_at: str) -> dict[str, Column]:
    return {
        "source": F.concat(F.lit(_file_name(path) + "#"), record.cast("string")),
        "confidence": F.lit(1.0),
        "loaded_at": F.lit(loaded_at),
    }


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, empty for missing cells; a byte-order mark is dropped."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8", inferSchema=False)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.lstrip("﻿")) for c in df.columns])


def _required(df: DataFrame, columns: list[str]) -> Column:
    """Reason for the first column the file lacks, else null."""
    missing = [c for c in columns if c not in df.columns]
    return F.lit(f"missing column {missing[0]}" if missing else None).cast("string")


def _with(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("*", *[F.lit("").alias(c) for c in columns if c not in df.columns])


def _split(df: DataFrame, reason: Column, key: str) -> tuple[DataFrame, DataFrame]:
    judged = df.withColumn("_reason", reason)
    good = judged.where(F.col("_reason").isNull()).drop("_reason")
    bad = judged.where(F.col("_reason").isNotNull())
    return good, _issues(bad, F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit("<no key>")), F.col("_reason"))


def _no_issues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "record string, reason string")


def load_materials(spark: SparkSession, path: str) -> Load:
    raw = read_csv(spark, path)
    df = _with(raw, ["id", "grade", "synonyms", "composition"])
    text = F.nullif(F.col("composition"), F.lit(""))
    parsed = F.from_json(text, "map<string,string>")
    bad_json = text.isNotNull() & (F.try_parse_json(text).isNull() | ~F.ltrim(text).startswith("{"))
    good, rejected = _split(df, F.coalesce(_required(raw, ["id", "grade"]), F.when(bad_json, "composition is not a JSON object")), "id")
    materials = good.select(
        "id", "grade", split_list("synonyms").alias("synonyms"),
        F.coalesce(parsed, F.create_map().cast("map<string,string>")).alias("composition"))
    variants = materials.select(
        "id", F.explode(F.array_distinct(F.transform(F.concat(F.array("grade"), "synonyms"), normalize_name))).alias("variant"))
    owners = variants.groupBy("variant").agg(F.min("id").alias("_owner"))
    clash = variants.join(owners, "variant").where(F.col("_owner") != F.col("id"))
    warnings = _issues(clash, F.col("id"), F.concat(F.lit("synonym "), "variant", F.lit(" is already taken by "), "_owner"))
    return Load(_file_name(path), materials, rejected, warnings, {"Material": materials})


def _load_simple(spark: SparkSession, path: str, label: str, columns: list[str]) -> Load:
    raw = read_csv(spark, path)
    good, rejected = _split(_with(raw, columns), _required(raw, columns), columns[0])
    rows = good.select(*columns)
    return Load(_file_name(path), rows, rejected, _no_issues(spark), {label: rows})


def load_equipment(spark: SparkSession, path: str) -> Load:
    return _load_simple(spark, path, "Equipment", ["id", "type", "lab"])


def load_staff(spark: SparkSession, path: str) -> Load:
    return _load_simple(spark, path, "Person", ["id", "name", "lab"])


def load_properties(spark: SparkSession, path: str) -> Load:
    return _load_simple(spark, path, "Property", ["name", "category"])


def load_documents(spark: SparkSession, path: str, graph: Graph, loaded_at: str) -> Load:
    raw = read_csv(spark, path)
    needed = ["id", "doc_type", "date", "title"]
    day = F.col("date").try_cast("date")
    good, rejected = _split(
        _with(raw, [*needed, "authors"]),
        F.coalesce(_required(raw, needed), F.when(day.isNull(), F.concat(F.lit("bad date "), "date"))), "id")
    documents = good.select("id", "doc_type", day.alias("date"), "title")
    people = graph.node("Person").select(F.col("id").alias("dst_id"), F.lit(True).alias("known"))
    written = good.select(F.col("id").alias("src_id"), F.explode(split_list("authors")).alias("dst_id")).join(people, "dst_id", "left")
    prov = provenance(path, F.col("src_id"), loaded_at)
    return Load(
        _file_name(path), documents, rejected,
        _issues(written.where("known is null"), F.col("src_id"), F.concat(F.lit("unknown author "), "dst_id")),
        {"Document": documents},
        {"AUTHORED_BY": written.where("known").select("src_id", "dst_id", *[c.alias(n) for n, c in prov.items()])},
    )


# --- experiments --------------------------------------------------------------

# numbers are read as text, so "12.5" and 12.5 are the same, and cast afterwards
EXPERIMENT = (
    "id string, date string, goal string, status string, material string, equipment_id string, "
    "regime struct<type:string,temp_min:string,temp_max:string,duration_h:string,medium:string>, "
    "measurements array<struct<property:string,value:string,unit:string,method:string,uncertainty:string>>, "
    "conclusions array<struct<id:string,text:string,confidence:string,date:string,doc_id:string,fragment:string,"
    "relates:array<struct<type:string,target:string>>>>"
)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of text files; line numbers count within each file.

    Only one row per file split is gathered to place the splits of a file one
    after another; the lines themselves are numbered where they are read.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(starts, ["file", "block"]).select(
        (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "line")


def _bad_number(c: Column, required: bool = False) -> Column:
    unreadable = c.isNotNull() & c.try_cast("double").isNull()
    return (unreadable | c.isNull()) if required else unreadable


def _problem(e: Column) -> Column:
    """Why a record is invalid, null when it is fine."""
    r, ms, cs = e["regime"], e["measurements"], e["conclusions"]
    blank = lambda c: c.isNull() | (strip(c) == "")
    bad_measurement = F.exists(ms, lambda m: m["property"].isNull() | m["unit"].isNull() | m["method"].isNull()
                               | _bad_number(m["value"], True) | _bad_number(m["uncertainty"]))
    bad_relation = lambda x: x["target"].isNull() | ~F.coalesce(x["type"].isin("supports", "contradicts"), F.lit(False))
    bad_conclusion = F.exists(cs, lambda c: c["text"].isNull() | c["date"].try_cast("date").isNull()
                              | ~F.coalesce(c["confidence"].try_cast("double").between(0, 1), F.lit(False))
                              | F.coalesce(F.exists(c["relates"], bad_relation), F.lit(False)))
    low, high = r["temp_min"].try_cast("double"), r["temp_max"].try_cast("double")
    checks = [
        (e["id"].isNull(), "id is missing"), (e["date"].try_cast("date").isNull(), "bad date"),
        (e["goal"].isNull(), "goal is missing"), (e["status"].isNull(), "status is missing"),
        (blank(e["material"]), "material is blank"), (blank(e["equipment_id"]), "equipment_id is blank"),
        (r.isNull() | r["type"].isNull(), "regime is missing"),
        (_bad_number(r["temp_min"]) | _bad_number(r["temp_max"]) | _bad_number(r["duration_h"]), "regime holds a bad number"),
        (low > high, "temp_min is above temp_max"),
        (F.coalesce(bad_measurement, F.lit(False)), "bad measurement"),
        (F.coalesce(bad_conclusion, F.lit(False)), "bad conclusion"),
    ]
    return F.coalesce(*[F.when(test, F.lit(text)) for test, text in checks])


def load_experiments(spark: SparkSession, path: str, graph: Graph, loaded_at: str) -> Load:
    lines = numbered_lines(spark, path).where(strip("line") != "")
    parsed = lines.select(
        "line_no", "line", F.try_parse_json("line").isNotNull().alias("is_json"), F.from_json("line", EXPERIMENT).alias("e"))
    judged = parsed.withColumn("problem", F.when(~F.col("is_json"), F.lit("not JSON")).otherwise(_problem(F.col("e"))))
    malformed = judged.where(F.col("problem").isNotNull())

    catalogue = graph.node("Material").select(
        F.lit("Material").alias("label"), F.col("id").alias("key"),
        F.array_compact(F.concat(F.array("grade"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("variants"))
    materials = variant_lookup(catalogue).select("variant", F.col("key").alias("material_id"))
    equipment = graph.node("Equipment").select(F.col("id").alias("equipment_id"), F.lit(True).alias("has_equipment"))
    referred = (
        judged.where(F.col("problem").isNull()).select("line", "e.*")
        .withColumns({"material": strip("material"), "equipment_id": strip("equipment_id")})
        .withColumn("variant", normalize_name("material"))
        .join(materials, "variant", "left").join(equipment, "equipment_id", "left")
    )
    unknown = F.coalesce(
        F.when(F.col("material_id").isNull(), F.concat(F.lit("unknown material "), "material")),
        F.when(F.col("has_equipment").isNull(), F.concat(F.lit("unknown equipment "), "equipment_id")))
    unresolved = referred.where(unknown.isNotNull())
    spec = F.get_json_object("line", "$.regime")
    kept = referred.where(unknown.isNull()).withColumn("regime_key", regime_key(spec))
    prov = [c.alias(n) for n, c in provenance(path, F.col("id"), loaded_at).items()]

    def edge(dst: str) -> DataFrame:
        return kept.select(F.col("id").alias("src_id"), F.col(dst).alias("dst_id"), *prov)

    # numbering precedes the filter, so skipped items keep their number
    measured = kept.select("id", F.posexplode("measurements").alias("pos", "m"), *prov).select(
        F.col("id").alias("exp"), F.concat("id", F.lit(":M"), F.col("pos") + 1).alias("id"), "m.*",
        "source", F.col("confidence"), "loaded_at")
    properties = graph.node("Property").select(F.col("name").alias("property"), F.lit(True).alias("known"))
    checked = measured.join(properties, "property", "left")
    valid = checked.where("known")
    concluded = kept.select("id", F.posexplode("conclusions").alias("pos", "c"), *prov).select(
        F.col("id").alias("exp"), F.coalesce(F.nullif(F.col("c.id"), F.lit("")), F.concat("id", F.lit(":C"), F.col("pos") + 1)).alias("id"),
        F.col("c.text").alias("text"), F.col("c.confidence").cast("double").alias("sure"), F.col("c.date").cast("date").alias("date"),
        F.col("c.doc_id").alias("doc_id"), F.col("c.fragment").alias("fragment"), F.col("c.relates").alias("relates"),
        "source", "confidence", "loaded_at")
    documents = graph.node("Document").select(F.col("id").alias("doc_id"), F.lit(True).alias("known"))
    described = concluded.where(F.col("doc_id").isNotNull()).join(documents, "doc_id", "left")
    existing = graph.node("Conclusion").select("id").union(concluded.select("id")).distinct()
    related = concluded.select("exp", F.col("id").alias("src_id"), F.explode("relates").alias("r"), "source", "confidence", "loaded_at") \
        .select("exp", "src_id", F.col("r.type").alias("type"), F.col("r.target").alias("dst_id"), "source", "confidence", "loaded_at") \
        .join(existing.select(F.col("id").alias("dst_id"), F.lit(True).alias("known")), "dst_id", "left")
    tail = ["source", "confidence", "loaded_at"]

    def relation(kind: str) -> DataFrame:
        return related.where(F.col("known") & (F.col("type") == kind)).select("src_id", "dst_id", *tail)

    warnings = [
        _issues(checked.where("known is null"), F.col("exp"), F.concat(F.lit("unknown property "), "property")),
        _issues(described.where("known is null"), F.col("exp"), F.concat(F.lit("unknown document "), "doc_id")),
        _issues(related.where("known is null"), F.col("exp"), F.concat(F.lit("unknown conclusion "), "dst_id")),
    ]
    number = lambda c: F.col(f"regime.{c}").cast("double").alias(c)
    return Load(
        _file_name(path), kept,
        _issues(malformed, F.concat(F.lit("line "), "line_no"), F.col("problem")).unionByName(_issues(unresolved, F.col("id"), unknown)),
        reduce(DataFrame.unionByName, warnings),
        nodes={
            "Experiment": kept.select("id", F.col("date").cast("date").alias("date"), "goal", "status"),
            "Regime": kept.select(
                F.col("regime_key").alias("key"), F.col("regime.type").alias("type"), number("temp_min"), number("temp_max"),
                number("duration_h"), F.col("regime.medium").alias("medium"),
                F.coalesce(F.get_json_object("line", "$.regime.params"), F.lit("{}")).alias("params")),
            "Measurement": valid.select("id", "property", F.col("value").cast("double").alias("value"), "unit", "method",
                                        F.col("uncertainty").cast("double").alias("uncertainty"), "source"),
            "Conclusion": concluded.select("id", "text", F.col("sure").alias("confidence"), "date"),
        },
        edges={
            "USES": edge("material_id"), "APPLIES": edge("regime_key"), "ON_EQUIPMENT": edge("equipment_id"),
            "YIELDS": valid.select(F.col("exp").alias("src_id"), F.col("id").alias("dst_id"), *tail),
            "OF_PROPERTY": valid.select(F.col("id").alias("src_id"), F.col("property").alias("dst_id"), *tail),
            "LEADS_TO": concluded.select(F.col("exp").alias("src_id"), F.col("id").alias("dst_id"), *tail),
            "DESCRIBED_IN": described.where("known").select(F.col("id").alias("src_id"), F.col("doc_id").alias("dst_id"), "fragment", *tail),
            "SUPPORTS": relation("supports"), "CONTRADICTS": relation("contradicts"),
        },
    )


# --- seed dictionaries ----------------------------------------------------------

# fixed values: seed file, its label and the label's own attribute
SEED_FILES = {
    "materials.csv": ("Material", "kind"),
    "processes.csv": ("Process", "category"),
    "equipment.csv": ("Equipment", "type"),
}


def seed_nodes(spark: SparkSession, path: str, label: str, extra: str) -> DataFrame:
    """Verified canonical nodes with all their written variants."""
    raw = _with(read_csv(spark, path), ["name", "name_en", "synonyms", extra])
    name, english = strip("name"), F.nullif(strip("name_en"), F.lit(""))
    return raw.where(name != "").select(
        entity_id(label, name).alias("id"), name.alias("name"), english.alias("name_en"),
        F.concat(F.array_compact(F.array(name, english)), split_list("synonyms")).alias("synonyms"),
        F.nullif(strip(extra), F.lit("")).alias(extra), F.lit(False).alias("needs_review"))


def load_seed(store: Store, folder: str) -> dict[str, int | None]:
    """Canonical nodes per seed file; None where a file is missing."""
    present = store._children(folder)
    counts: dict[str, int | None] = {}
    for file, (label, extra) in SEED_FILES.items():
        counts[file] = None
        if file in present:
            nodes = seed_nodes(store.spark, f"{folder}/{file}", label, extra)
            store.merge_nodes(label, nodes)
            counts[file] = nodes.count()
    return counts


# --- registry -------------------------------------------------------------------

# fixed values: kinds in loading order (later ones refer to earlier ones)
LOADERS = {
    "materials": ("materials.csv", lambda store, path, now: load_materials(store.spark, path)),
    "equipment": ("equipment.csv", lambda store, path, now: load_equipment(store.spark, path)),
    "staff": ("staff.csv", lambda store, path, now: load_staff(store.spark, path)),
    "properties": ("properties.csv", lambda store, path, now: load_properties(store.spark, path)),
    "documents": ("documents.csv", lambda store, path, now: load_documents(store.spark, path, store.graph(), now)),
    "experiments": ("experiments.jsonl", lambda store, path, now: load_experiments(store.spark, path, store.graph(), now)),
}


def load(store: Store, kind: str, path: str, loaded_at: str) -> Load:
    result = LOADERS[kind][1](store, path, loaded_at)
    result.save(store)
    return result


def load_all(store: Store, folder: str, loaded_at: str) -> dict[str, Load | None]:
    present = store._children(folder)
    return {
        kind: load(store, kind, f"{folder}/{file}", loaded_at) if file in present else None
        for kind, (file, _) in LOADERS.items()
    }
