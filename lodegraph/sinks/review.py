"""Expert review of nodes: approve, edit, comment, reject.

Each operation takes the node table (and for rejection the whole graph) and
returns the new one; `act` is the dispatcher for a single node.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph import model
from lodegraph.access import User
from lodegraph.functions.text import strip
from lodegraph.graph import REVIEWABLE_LABELS, Frames, Graph, column_or_null, first_present, key_is

REVIEW_COLUMNS = {
    "needs_review": "boolean", "review_status": "string", "reviewed_by": "string", "reviewed_at": "string",
    "review_notes": "array<string>",
}


class NotFound(LookupError):
    """No node has the given key."""


def with_review_columns(nodes: DataFrame) -> DataFrame:
    missing = {c: column_or_null(nodes, c, kind) for c, kind in REVIEW_COLUMNS.items() if c not in nodes.columns}
    return nodes.withColumns(missing) if missing else nodes


def _settle(nodes: DataFrame, chosen: Column, status: str, by: str, now: str, changes: Mapping[str, Column]) -> DataFrame:
    values = {
        "needs_review": F.lit(False), "review_status": F.lit(status), "reviewed_by": F.lit(by),
        "reviewed_at": F.lit(now), **changes,
    }
    return nodes.withColumns({
        c: F.when(chosen, v.cast(nodes.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()
    })


def approve(nodes: DataFrame, keys: DataFrame, by: str, now: str) -> DataFrame:
    """Marks every node whose id is among `keys` as reviewed."""
    marked = with_review_columns(nodes).join(keys.select(F.col("id"), F.lit(True).alias("_chosen")), "id", "left")
    return _settle(marked, F.coalesce("_chosen", F.lit(False)), "approve", by, now, {}).drop("_chosen")


def edit_values(label: str, action: Mapping[str, Any]) -> dict[str, Column]:
    """Attributes an edit sets: blank names and texts are ignored, a blank
    geography is removed, empty synonyms are dropped."""
    given = lambda key: (action.get(key) or "").strip()
    changes: dict[str, Column] = {}
    if label == "Conclusion":
        if given("text"):
            changes["text"] = F.lit(given("text"))
        if action.get("geography") is not None:
            changes["geography"] = F.lit(given("geography") or None)
    else:
        if given("name"):
            changes["name"] = F.lit(given("name"))
        if action.get("synonyms") is not None:
            kept = [s.strip() for s in action["synonyms"] if s.strip()]
            changes["synonyms"] = F.array(*[F.lit(s) for s in kept]).cast("array<string>")
    return changes


def comment(nodes: DataFrame, chosen: Column, user: str, now: str, note: str) -> DataFrame:
    entry = F.array(F.lit(f"{user} ({now}): {note.strip()}"))
    notes = F.coalesce("review_notes", F.array().cast("array<string>"))
    return nodes.withColumn("review_notes", F.when(chosen, F.concat(notes, entry)).otherwise(F.col("review_notes")))


def reject(graph: Graph, label: str, keys: DataFrame) -> tuple[DataFrame, Frames]:
    """(node table, edge tables) without the given nodes and all their edges."""
    node = graph.node(label)
    key = "id" if "id" in node.columns else "name"
    gone = keys.toDF("_gone").select(F.col("_gone").cast("string"))
    nodes = node.join(gone, F.col(key) == F.col("_gone"), "left_anti")
    edges = {kind: (lambda kind=kind: _detach(kind, graph.edge(kind), label, gone)) for kind in graph.edges}
    return nodes, Frames(edges)


def _detach(kind: str, edges: DataFrame, label: str, gone: DataFrame) -> DataFrame:
    src, dst = model.ENDS[kind]
    if src == label:
        edges = edges.join(gone, F.col("src_id") == F.col("_gone"), "left_anti")
    if dst == label:
        edges = edges.join(gone, F.col("dst_id") == F.col("_gone"), "left_anti")
    if dst is None and label in ("Material", "Process", "Equipment", "Facility"):
        edges = edges.join(gone, (F.col("dst_id") == F.col("_gone")) & (F.col("dst_label") == label), "left_anti")
    return edges


def act(graph: Graph, op: str, label: str, key: str, user: User, now: str,
        action: Mapping[str, Any] | None = None) -> tuple[Graph, dict[str, Any]]:
    """One review action on one node: the changed graph and a receipt."""
    user.require("can_edit_graph")
    action = action or {}
    if op not in ("approve", "edit", "comment", "reject"):
        raise ValueError("op must be approve, edit, comment or reject")
    nodes = graph.node(label, REVIEWABLE_LABELS)
    if op == "comment" and not (action.get("note") or "").strip():
        raise ValueError("empty comment")
    chosen = key_is(nodes, key)
    found = nodes.where(chosen).select(
        first_present(nodes, ("name", "text", "id")).alias("name"), first_present(nodes, ("id", "name")).alias("key"))
    row = found.first()
    if row is None:
        raise NotFound(key)
    changed, edges, shown = with_review_columns(nodes), graph.edges, row["name"]
    if op == "reject":
        changed, edges = reject(graph, label, found.select("key"))
    elif op == "comment":
        changed = comment(changed, chosen, user.name, now, action["note"])
    else:
        changes = edit_values(label, action) if op == "edit" else {}
        for c in changes:
            if c not in changed.columns:
                changed = changed.withColumn(c, F.lit(None).cast("array<string>" if c == "synonyms" else "string"))
        changed = _settle(changed, chosen, op, user.name, now, changes)
        shown = action["name"].strip() if "name" in changes else action["text"].strip() if "text" in changes else shown
    receipt = {"ok": True, "op": op, "label": label, "key": key, "name": shown}
    return Graph(graph.nodes.with_tables(**{label: changed}), edges), receipt
