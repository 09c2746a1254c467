import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lexmill.runtime import session

    s = session("local[4]", 4, spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")), spark__sql__autoBroadcastJoinThreshold="256k")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
