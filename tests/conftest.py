import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
FIXTURES = os.path.join(ROOT, "tests", "fixtures")
SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from calltrail.session import get_spark
    s = get_spark(master="local[*]", shuffle_partitions=8)
    yield s


@pytest.fixture
def fx():
    return lambda name: os.path.join(FIXTURES, name)
