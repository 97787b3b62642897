import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessera.session import build_session, ship

    session = build_session("tests", "local[4]", 4, spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('shared')}", spark__sql__shuffle__partitions="4")
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()
