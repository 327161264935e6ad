import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from vitalgrid.session import local_session
    session = local_session("tests", cpus=8, partitions=8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def ts():
    """Text to a timestamp column value."""
    import datetime
    return datetime.datetime.fromisoformat
