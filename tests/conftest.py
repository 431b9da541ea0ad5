import pytest

from codelode.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session(master="local[4]", shuffle_partitions=4, driver_memory="4g")
