import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text, source) rows, with columns that operators must not mind."""

    def make(rows):
        schema = "doc_id long, text string, source string, lang string, n_chars long, score double, region string, `group` int, doc string"
        return spark.createDataFrame([(*r, "en", None, 0.5, "x", 1, "y") for r in rows], schema)

    return make
