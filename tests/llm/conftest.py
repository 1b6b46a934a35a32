import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from llm_fixtures import DOCS, document_rows, messy  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return messy(spark, document_rows(), DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return messy(spark, [], DOCS)
