import pytest

from codecloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, app="codecloom-tests", memory="8g")
    yield session
    session.stop()
