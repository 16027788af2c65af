import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablelens.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8, app_name="tablelens-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def edge_profile(spark):
    """FIXTURES 3.1: id, x, t, b with NULL, NaN and an outlier."""
    rows = [(1, 1.0, "a", True), (2, 2.0, "b", False), (3, 3.0, None, True), (4, 4.0, "a", True),
            (5, 100.0, "c", None), (6, None, "a", False), (7, float("nan"), None, True), (8, 4.0, "b", True)]
    return spark.createDataFrame(rows, "id long, x double, t string, b boolean")
