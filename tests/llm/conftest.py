import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))]


@pytest.fixture(scope="session")
def documents(spark):
    """Builds (doc_id, text[, source]) tables with other columns whose names the operators use themselves."""

    def make(rows, source="s"):
        full = [(r[0], r[1], r[2] if len(r) > 2 else source, 1, "x", 0.5, 7) for r in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, source string, block int, bucket string, score double, size int")

    return make
