import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from framelake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", "4g", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA


def rows(df, *order):
    return sorted(tuple(r) for r in df.select(*order).collect()) if order else sorted(map(tuple, df.collect()))
