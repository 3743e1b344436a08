import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from stratapanel.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tiny_buckets(monkeypatch):
    """Many buckets on little data, so that ranks really cross bucket borders."""
    from stratapanel.operators import ranks

    monkeypatch.setattr(ranks, "ROWS_PER_BUCKET", 5)
