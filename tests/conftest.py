import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
# Python workers start with the environment that the JVM gets
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

SMALLEST = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tidegauge.session import get_session

    session = get_session("tests", 4)
    yield session
    session.stop()


@pytest.fixture
def sf_dir():
    if not os.path.isdir(SMALLEST):
        pytest.skip("no shared tables here")
    return SMALLEST
