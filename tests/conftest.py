import pytest

from cueforge.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(cpus=8, partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    return s
