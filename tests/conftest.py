import os
import sys

import pytest

ROOT = os.path.join(os.path.dirname(__file__), "..")
sys.path.insert(0, os.path.abspath(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.abspath(ROOT), os.environ.get("PYTHONPATH", "")])

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from stackpool.session import build_session
    s = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
                      spark__ui__showConsoleProgress="false", spark__driver__memory="4g",
                      spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoint")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
