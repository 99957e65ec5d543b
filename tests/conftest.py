import pytest

from foliant.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", 4)
    yield session
    session.stop()
