import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from marlstone.session import build_session

    session = build_session("local[4]", "tests", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()
