import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from parley.spark import get_spark, remove_work

    s = get_spark("local[4]", app="parley-tests", shuffle_partitions=4)
    yield s
    remove_work(s)
    s.stop()
