from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tickerloom.session import local_session

    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session(4, "tests", **{"spark.checkpoint.dir": shared})
    yield session
    session.stop()
