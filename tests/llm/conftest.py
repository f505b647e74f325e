import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, word string, label int"


@pytest.fixture
def docs(spark):
    """Documents with clashing extra columns, from texts or (doc_id, text) pairs."""
    def make(*texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, None, None, None, "x", None, 1) for i, t in rows], DOC_SCHEMA)
    return make


@pytest.fixture(scope="session")
def small():
    """The smallest tables as pandas."""
    import pyarrow.parquet as pq

    return lambda name: pq.read_table(f"{SMALL}/{name}.parquet").to_pandas()
