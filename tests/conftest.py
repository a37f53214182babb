import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from opsmetrics import build_session

    session = build_session("local[*]", app_name="opsmetrics-tests", shuffle_partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="opsmetrics-test-")


def rows(df, *cols):
    """Collected rows as tuples (of the given columns), sorted for comparison."""
    out = [tuple(r[c] for c in (cols or df.columns)) for r in df.collect()]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))
