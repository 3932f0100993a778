import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from corpusflow.session import build_session

    s = build_session(master="local[4]", shuffle_partitions=8, app="corpusflow-tests")
    yield s
    s.stop()
