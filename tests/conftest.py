import pytest

from pricetide.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4, app="pricetide-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
