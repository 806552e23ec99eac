import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridpulse.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture
def rows():
    """Collect a frame as a sorted list of plain tuples."""

    def collect(df, *columns):
        if columns:
            df = df.select(*columns)
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return collect
