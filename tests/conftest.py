import pytest

from folioscale.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="4", shuffle=4, memory="3g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
