import pytest

from tickloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "tickloom-tests")
    s.sparkContext.setLogLevel("ERROR")
    return s
