import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidemark.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session("tidemark-tests", master="local[8]")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of an expression over one row of named texts."""

    def run(expr, **values):
        row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
        return row.select(expr.alias("x")).first().x

    return run
