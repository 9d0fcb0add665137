import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from netsentry.session import local_session
    s = local_session("*", 8, app="netsentry-tests")
    yield s
    s.stop()


@pytest.fixture()
def scratch(spark):
    """A fresh folder below the shared checkpoint folder."""
    from netsentry.session import scratch_path
    return scratch_path(spark, "test")
