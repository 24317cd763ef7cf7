import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lodegraph.session import local_session  # noqa: E402
from lodegraph.sinks.store import Store  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=2, memory="6g")
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-test-", dir="/tmp")


@pytest.fixture
def store(spark, folder):
    return Store(spark, f"{folder}/store")
