import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from fixtures import tables, texts  # noqa: E402


@pytest.fixture(scope="session")
def small(tmp_path_factory):
    """A folder of small tables, and the texts of its documents by id."""
    docs = texts()
    return tables(tmp_path_factory.mktemp("small"), docs), dict(enumerate(docs, 3))


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("empty"), [])
