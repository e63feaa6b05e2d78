import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

from rows import SF, documents, edge_rows  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark):
    return documents(spark, edge_rows()).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return documents(spark, []).cache()


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()
