import pytest

from cairnset.session import local_session, ship_package


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", spark__sql__shuffle__partitions="4", spark__driver__memory="3g")
    ship_package(session)
    return session
