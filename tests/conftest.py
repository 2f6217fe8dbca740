import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from chronolith.runtime import local_session

    session = local_session("tests", cpus=os.environ.get("TEST_CPUS", "4"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    """The smallest driver tables."""
    path = DATA / "sf0.001"
    if not path.exists():
        pytest.skip("no test data here")
    return str(path)
