import pytest

from pagework.llm.common import ship_package


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture
def long_text():
    return "Théy ran & ran. " * 20_000 + "x" * 70_000
