import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tideline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", 4, spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("wh")), spark__driver__memory="4g")
    yield session
    session.stop()
