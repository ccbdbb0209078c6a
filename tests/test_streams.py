"""Streams whose last step of inflating yields the end only."""

import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loamspark.functions import codecs as C
from loamspark.plans import block_queries

from .oracle import differences


@pytest.mark.parametrize("raw", (b"", bytes(1 << 20), b"ab" * (1 << 20)))
def test_last_part_is_empty(raw):
    for level in range(1, 10):
        stream = zlib.compress(raw, level)
        got = C.inflate(stream)
        assert got is not None and got[0] == raw and C.deflate(*got) == stream
        assert C.inflated(stream[:-1]) is None


def test_stream_trials_of_empty_texts(spark, tmp_path):
    texts = ["", None, "", "a", "", "some text", "", "b" * (1 << 20), "", "c" * 3000]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), tmp_path / "documents.parquet")
    assert differences(spark, block_queries.QUERIES["stream_trials"], block_queries.SQL["stream_trials"], str(tmp_path)) == ""
