"""Python workers: one for each task, whatever a query asks of a text, and batches of bounded bytes."""

import pytest

from loamspark.operators import counting
from loamspark.plans import catalogue


@pytest.mark.parametrize("name", ("codec_roundtrip", "masked_matches", "last_match_kgram"))
def test_one_worker_a_task(spark, name):
    """Each evaluation of a Python function that takes batches has a worker of its own."""
    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("ArrowEvalPython [") == 1


@pytest.mark.parametrize("name", ("codec_roundtrip", "stream_trials", "containers", "segment_blocks", "masked_matches", "language_rule"))
def test_batches_are_bounded(spark, name):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        catalogue.queries()[name](spark, "/root/testdata/sf0.001")
        assert int(str(spark.conf.get(key)).rstrip("b")) == counting.BATCH_BYTES
    finally:
        spark.conf.set(key, was)
