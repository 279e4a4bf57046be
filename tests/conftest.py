import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from graphloom.session import local_session

    os.environ.setdefault("PYTHONPATH", sys.path[0])
    os.environ.setdefault("GRAPHLOOM_DRIVER_MEMORY", "4g")
    s = local_session(4, 4)
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield s
    s.stop()
