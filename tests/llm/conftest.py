import pytest

from checks.ship import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)
