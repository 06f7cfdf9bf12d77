import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from sievewright.session import local_session

    s = local_session(4, shuffle_partitions=4, memory="3g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    at = "/root/testdata/sf0.001"
    if not os.path.isdir(at):
        pytest.skip("the test tables are not here")
    return at
