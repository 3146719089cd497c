import pytest

from quarry.settings import session


@pytest.fixture(scope="session")
def spark():
    return session()
