import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.config import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="tidemark-tests-")
    session = build_session(
        "tidemark-tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="4g",
        spark__checkpoint__dir=f"{folder}/shared",
        spark__sql__warehouse__dir=f"{folder}/warehouse",
        spark__sql__codegen__cache__maxEntries="1000",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
