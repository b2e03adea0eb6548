import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Table of documents from (doc_id, text) pairs, with columns whose names invite clashes."""
    def make(rows):
        extra = [(i, t, 7, "x", None, "y") for i, t in rows]
        return spark.createDataFrame(
            extra, "doc_id long, text string, id int, start string, hash long, shard string")
    return make


@pytest.fixture(scope="session")
def tiny():
    """Rows of the smallest documents table."""
    import pyarrow.parquet as pq
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
