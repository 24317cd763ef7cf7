"""Deterministic keys."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodegraph.functions.text import _col, normalize_name


def document_id(rel_path: Column | str) -> Column:
    """Always from the `/` form of the path, so ids do not depend on the OS."""
    path = F.replace(_col(rel_path), F.lit("\\"), F.lit("/"))
    return F.concat(F.lit("D"), F.substring(F.sha1(path), 1, 12))


def chunk_id(doc_id: Column | str, seq: Column | str) -> Column:
    return F.concat_ws(":", _col(doc_id).cast("string"), _col(seq).cast("string"))


def entity_id(label: str, name: Column | str) -> Column:
    return F.concat(F.lit(f"{label[0]}:"), normalize_name(name))


def person_id(name: Column | str) -> Column:
    return F.concat(F.lit("P:"), normalize_name(name))


def _regime_digest(text: str | None) -> str | None:
    if text is None:
        return None
    spec = json.loads(text)
    number = {k: None if spec.get(k) is None else float(spec[k]) for k in ("temp_min", "temp_max", "duration_h")}
    body = {
        **number,
        "type": spec["type"].strip().casefold(),
        "medium": (spec.get("medium") or "").strip().casefold() or None,
        # a numeric parameter is a float whichever way it was written
        "params": {
            k: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
            for k, v in (spec.get("params") or {}).items()
        },
    }
    canonical = json.dumps(body, sort_keys=True, ensure_ascii=False)
    return hashlib.sha1(canonical.encode("utf-8")).hexdigest()[:16]


@F.pandas_udf(StringType())
def regime_key(spec_json: pd.Series) -> pd.Series:
    """Key of a treatment regime from its JSON object; equal regimes share it.

    Python because the key is a digest of Python's own JSON number format.
    """
    return spec_json.map(_regime_digest)
