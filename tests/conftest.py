import pytest

from tests.compare import session


@pytest.fixture(scope="session")
def spark():
    s = session()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def sf():
    return "/root/testdata/sf0.001"
