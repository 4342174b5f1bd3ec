import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from helixframe.session import local_session

    s = local_session(cpus=4, shuffle_partitions=8, app="helixframe-tests")
    yield s
    s.stop()
