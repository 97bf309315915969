import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session

    s = local_session("*", shuffle_partitions=8, app="tidemark-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_small():
    from tools.oracle_check import duck_connect

    return duck_connect(SF_SMALL)
