import pytest

from . import fixtures


@pytest.fixture(scope="session")
def documents(spark):
    return fixtures.documents(spark).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return fixtures.documents(spark, [])
