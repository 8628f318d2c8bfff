import pytest

from corpuskiln.session import local_session
from corpuskiln.tables import drop_written


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_written(session)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
