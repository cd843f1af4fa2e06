import pytest

from quire.session import get_spark


@pytest.fixture(scope="session")
def spark():
    return get_spark("local[4]", partitions=4, app="quire-llm-tests")
