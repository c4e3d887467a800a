import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lakeloom.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session(cores=8, shuffle_partitions=4)


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("LAKELOOM_TEST_DIR", "/root/testdata/sf0.001")
