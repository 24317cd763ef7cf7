"""Vector similarity and the encoder seam."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], list[list[float]]]


def unit_rows(m: np.ndarray) -> np.ndarray:
    """The rows of a matrix at length one; rows without a length stay."""
    length = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
    return np.divide(m, length, out=m.copy(), where=length > 0)


def cosine_to(vector: Sequence[float]) -> Callable[[Column | str], Column]:
    """A similarity function to one fixed vector.

    The column is read batch-wise as one flat Arrow buffer, so a batch costs a
    single matrix product. A null vector, one of no or no finite length and one
    of another number of components get a null score, as does everything if
    the fixed vector is such a one.
    """
    q = np.asarray(vector, dtype=np.float64)
    length = np.linalg.norm(q)
    q = q / length if length > 0 else np.full(q.shape, np.nan)

    @F.arrow_udf("double")
    def cosine(column: pa.Array) -> pa.Array:
        scores = np.zeros(len(column))
        sizes = pa.compute.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
        valid = sizes == q.size
        flat = column.filter(pa.array(valid)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if flat.size:
            m = flat.reshape(-1, q.size)
            with np.errstate(divide="ignore", invalid="ignore"):
                scores[valid] = (m @ q) / np.sqrt(np.einsum("ij,ij->i", m, m))
        return pa.array(scores, mask=~np.isfinite(scores) | ~valid)

    return lambda c: cosine(F.col(c) if isinstance(c, str) else c)


def hashing_encoder(dims: int = 384) -> Encoder:
    """Deterministic stand-in for an embedding model.

    Counts words in hashed buckets with a hashed sign. It carries no claim of
    semantic quality; it exists so the jobs around it run without a model file.
    """
    word = re.compile("[а-яёa-z0-9]+", re.IGNORECASE)

    def encode(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(dims)
            for w in word.findall((text or "").casefold()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % dims] += 1.0 if h >> 63 else -1.0
            norm = float(np.linalg.norm(v))
            out.append((v / norm if norm else v).tolist())
        return out

    return encode


def encode_column(make_encoder: Callable[[], Encoder], batch: int = 200) -> Callable[[Column | str], Column]:
    """Column of vectors for a column of texts; the model loads once per task."""

    @F.pandas_udf("array<float>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for part in parts:
            texts = part.fillna("").tolist()
            vectors: list[list[float]] = []
            for i in range(0, len(texts), batch):
                vectors.extend(encoder(texts[i:i + batch]))
            yield pd.Series(vectors, index=part.index, dtype=object)

    return lambda c: encode(F.col(c) if isinstance(c, str) else c)
