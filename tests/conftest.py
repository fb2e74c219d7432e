from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pagelens.session import local_session  # noqa: E402

DATA = os.environ.get("PAGELENS_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA
