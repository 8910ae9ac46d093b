import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from loomgraph.session import local_session

    session = local_session("8", "tests", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck_con():
    from harness import duck

    return duck(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
