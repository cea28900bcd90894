import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskframe.session import local_session  # noqa: E402

SF = os.environ.get("RISKFRAME_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, memory="4g", shuffle_partitions=4, app="riskframe-tests")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("the test tables are not here")
    return SF


def rows(df, *order):
    """Collected rows as plain tuples, sorted."""
    return sorted([tuple(r) for r in (df.select(*order) if order else df).collect()], key=repr)
