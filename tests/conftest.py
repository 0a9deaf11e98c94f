import os
import sys

import pytest
from pyspark import SparkConf

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sluiceway.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    # a running session refuses this setting, so it is given to the builder; a folder named by the defaults stays
    folder = SparkConf().get("spark.checkpoint.dir", None) or str(tmp_path_factory.mktemp("shared"))
    session = build_session("tests", "local[8]", 8, {"spark.checkpoint.dir": folder})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *cols):
    """Sorted tuples of the given columns."""
    names = cols or df.columns
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=lambda t: tuple((v is not None, v) for v in t))


@pytest.fixture(scope="session")
def rows_of():
    return rows
