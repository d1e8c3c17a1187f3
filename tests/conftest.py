import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from wireloom.session import local_session, ship

    session = local_session(4, "tests")
    ship(session)
    yield session


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("SF_DIR", "/root/testdata/sf0.001")
