import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from placerank.session import get_spark
    s = get_spark("tests", master="local[4]", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture
def large_path(spark):
    """Force the range-sort (large group) code paths of rank and quantile operators."""
    spark.conf.set("placerank.smallGroupRows", "0")
    yield
    spark.conf.unset("placerank.smallGroupRows")


def rows(df, *cols):
    cols = cols or df.columns
    return [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
