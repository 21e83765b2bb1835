import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def messy(spark):
    from llm_cases import frame
    return frame(spark).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    from llm_cases import frame
    return frame(spark, [])
