import pytest
from llm_rows import MESSY, frame


@pytest.fixture(scope="session")
def messy(spark):
    return frame(spark, MESSY).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"
