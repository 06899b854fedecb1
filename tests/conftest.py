import pytest

from cliploom.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", cores="8")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
