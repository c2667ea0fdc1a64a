import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from probita.session import build_session
    session = build_session("tests", master="local[4]", partitions=4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
