import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortlab import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session.build("local[8]", 8, spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
                      spark__checkpoint__dir=str(tmp_path_factory.mktemp("steps")))
    s.sparkContext.setLogLevel("FATAL")
    yield s
    s.stop()
