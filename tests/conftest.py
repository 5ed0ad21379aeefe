import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from reviewloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "4g")
    yield session
    session.stop()


@pytest.fixture
def apply(spark):
    """The values of a column function over some texts, in order."""

    def run(fn, *texts):
        rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
        return [r["v"] for r in rows.select("id", fn(rows["text"]).alias("v")).orderBy("id").collect()]

    return run
