"""Runs registered queries beside their SQL and compares whole results.

    python -m workload.check [scale folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

import workload
from lodegraph.session import local_session


# pandas has several names for one column with nulls
KINDS = {"object": "any", "str": "any", "string": "any", "bool": "any", "boolean": "any", "float64": "number",
         "int32": "number", "int64": "number"}


def frames_differ(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    left, right = (df[sorted(df.columns)] for df in (left, right))
    if list(left.columns) != list(right.columns):
        return f"columns {list(left.columns)} / {list(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    kinds = [[KINDS.get(str(t).lower(), str(t)) for t in df.dtypes] for df in (left, right)]
    types = [(c, a, b) for c, a, b in zip(left.columns, *kinds) if a != b]
    rows = []
    for df in (left, right):
        text = df.astype(object).where(df.notna(), None)
        rows.append(sorted(map(repr, text.itertuples(index=False, name=None))))
    if rows[0] != rows[1]:
        a, b = next((a, b) for a, b in zip(*rows) if a != b)
        bad = sum(x != y for x, y in zip(*rows))
        return f"{bad} values, types {types}: {a[:600]} / {b[:600]}"
    return f"types only: {types}" if types else None


def main() -> int:
    base = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(workload.QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    db = duckdb.connect()
    for f in sorted(Path(base).glob("*.parquet")):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    failed = 0
    for name in names:
        began, checked = time.time(), 0.0
        try:
            got = workload.QUERIES[name](spark, base).toPandas()
            spent = time.time() - began
            problem = None
            if name in workload.ORACLES:
                want = db.execute(workload.ORACLES[name]).df()
                checked = time.time() - began - spent
                problem = frames_differ(got, want)
        except Exception as error:  # noqa: BLE001 - reported below
            spent, problem, got = time.time() - began, f"{type(error).__name__}: {str(error).split('JVM stacktrace')[0][:700]}", []
        failed += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name:28s} {len(got):8d} rows {spent:6.2f}s {checked:6.2f}s {problem or ''}", flush=True)
    print(f"{failed} of {len(names)} differ")
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
