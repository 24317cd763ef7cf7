"""Table layouts of the graph store: one StructType per label and edge type."""

from __future__ import annotations

from pyspark.sql.types import StructType

_REVIEW = ", needs_review boolean, review_status string, reviewed_by string, reviewed_at string, review_notes array<string>"
_ENTITY = "id string, name string, name_en string, synonyms array<string>"
_PROV = "source string, unit string, confidence double, loaded_at string, extracted_at string, model string"
CONDITIONS = (
    "array<struct<parameter:string,op:string,value:double,value_max:double,unit:string,raw:string>>"
)

NODES = {
    "Material": f"{_ENTITY}, grade string, composition map<string,string>, kind string, created_at string" + _REVIEW,
    "Process": f"{_ENTITY}, category string, created_at string" + _REVIEW,
    "Equipment": f"{_ENTITY}, type string, lab string, created_at string" + _REVIEW,
    "Facility": "name string, country string, created_at string" + _REVIEW,
    "Document": "id string, title string, category string, doc_type string, journal string, conference string, "
                "year int, date date, language string, rel_path string, units int, chars bigint",
    "Chunk": "id string, doc_id string, seq int, unit_no int, unit_kind string, text string, "
             "digest bigint",
    # vectors of the texts with that digest, apart from the texts: making one rewrites no text
    "ChunkVector": "id string, doc_id string, digest bigint, embedding array<float>",
    # which chunks were extracted: kept apart, so that marking rewrites no text
    "ChunkState": "id string, extracted_at string",
    "Property": "name string, category string" + _REVIEW,
    "Measurement": "id string, doc_id string, property string, value double, value_max double, unit string, "
                   f"method string, uncertainty double, conditions {CONDITIONS}, source string, place string",
    "Conclusion": "id string, text string, confidence double, geography string, date date, version int, "
                  "updated_at string" + _REVIEW,
    "ConclusionVersion": "conclusion_id string, version int, text string, confidence double, geography string, "
                         "archived_at string, archived_by_model string",
    "Experiment": "id string, date date, goal string, status string",
    "Regime": "key string, type string, temp_min double, temp_max double, duration_h double, medium string, params string",
    "Person": "id string, name string, lab string" + _REVIEW,
    "TopicTag": "name string" + _REVIEW,
}
KEYS = {
    "Facility": ["name"], "Property": ["name"], "TopicTag": ["name"], "Regime": ["key"],
    "ConclusionVersion": ["conclusion_id", "version"],
}
EDGES = {
    "MENTIONS": f"src_id string, dst_label string, dst_id string, count bigint, {_PROV}",
    # counts of a stream, as they stand; read as part of MENTIONS
    "MENTIONS_STREAMED": f"src_id string, dst_label string, dst_id string, count bigint, {_PROV}",
    # counts of the extraction, one row for each chunk an edge was found in; read as part of MENTIONS
    "MENTIONS_EXTRACTED": f"src_id string, dst_label string, dst_id string, count bigint, {_PROV}",
    "DESCRIBED_IN": f"src_id string, dst_id string, fragment string, {_PROV}",
    "ABOUT": f"src_id string, dst_label string, dst_id string, {_PROV}",
    **{
        kind: f"src_id string, dst_id string, {_PROV}"
        for kind in ("REPORTS", "OF_PROPERTY", "TAGGED", "AUTHORED_BY", "USES", "APPLIES", "ON_EQUIPMENT",
                     "YIELDS", "LEADS_TO", "SUPPORTS", "CONTRADICTS")
    },
}
# tables whose counts readers see added to those of MENTIONS
MENTION_PARTS = ("MENTIONS_STREAMED", "MENTIONS_EXTRACTED")
# edges that are columns of their child table
DERIVED = {
    "HAS_CHUNK": ("Chunk", "doc_id", "id"),
    "HAD_VERSION": ("ConclusionVersion", "conclusion_id", "version"),
}

# --- fixed values: which labels an edge type joins (None: told by dst_label) ----
ENDS = {
    "HAS_CHUNK": ("Document", "Chunk"), "MENTIONS": ("Document", None), "REPORTS": ("Document", "Measurement"),
    "OF_PROPERTY": ("Measurement", "Property"), "DESCRIBED_IN": ("Conclusion", "Document"), "ABOUT": ("Conclusion", None),
    "TAGGED": ("Document", "TopicTag"), "AUTHORED_BY": ("Document", "Person"),
    "HAD_VERSION": ("Conclusion", "ConclusionVersion"), "USES": ("Experiment", "Material"),
    "APPLIES": ("Experiment", "Regime"), "ON_EQUIPMENT": ("Experiment", "Equipment"),
    "YIELDS": ("Experiment", "Measurement"), "LEADS_TO": ("Experiment", "Conclusion"),
    "SUPPORTS": ("Conclusion", "Conclusion"), "CONTRADICTS": ("Conclusion", "Conclusion"),
}
# -----------------------------------------------------------------------------


def node_key(label: str) -> list[str]:
    return KEYS.get(label, ["id"])


def edge_key(kind: str) -> list[str]:
    return ["src_id", "dst_label", "dst_id"] if "dst_label" in EDGES[kind] else ["src_id", "dst_id"]


def layout(name: str) -> StructType:
    return StructType.fromDDL(NODES.get(name) or EDGES[name])
