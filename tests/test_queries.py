"""Every registered query against its SQL, over whole tables."""

from pathlib import Path

import duckdb
import pytest

import workload
from workload.check import frames_differ

BASE = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not BASE.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for f in BASE.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return connection


def test_every_query_has_sql():
    assert set(workload.ORACLES) == set(workload.QUERIES)


@pytest.mark.parametrize("name", sorted(workload.QUERIES))
def test_query(spark, db, name):
    df = workload.QUERIES[name](spark, str(BASE))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = df.toPandas()
    assert frames_differ(got, db.execute(workload.ORACLES[name]).df()) is None
