import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_cases import frame, odd_rows  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, odd_rows()).cache()


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [(1, "x", "a")]).where("doc_id < 0")
