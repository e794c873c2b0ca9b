import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from savora.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, partitions=4, app="tests")


@pytest.fixture
def tiny_buckets(monkeypatch):
    """Make even small tables span many buckets."""
    from savora.functions import ordering

    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", 7)
