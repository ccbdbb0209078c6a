"""Entropies of all orders, counted by task and bucket: against a plain recount, on odd texts and with little room."""

import math
from collections import Counter

import pytest

from loamspark.operators import grams
from loamspark.plans import catalogue

TEXTS = [("a", "the cat and the dog " * 20), ("b", ""), (None, "x"), ("b", None), ("b", "日本語🙂é" * 9), ("a", "".join(chr(300 + i * 7 % 700) for i in range(900))), ("a", "the cat"), ("b", "the \x02 end"), ("a", "".join(chr(1200 + i * 7 % 400) for i in range(900)))]


@pytest.mark.parametrize("held, bucket", ((10, 60), (grams.HELD, grams.BUCKET)))
@pytest.mark.parametrize("order", (0, 2, 6))
def test_ladder(spark, monkeypatch, order, held, bucket):
    monkeypatch.setattr(grams, "HELD", held)
    monkeypatch.setattr(grams, "BUCKET", bucket)
    n, per, total = Counter(), Counter(), Counter()
    for key, t in TEXTS:
        p = "\x02" * order + (t or "")
        for i in range(len(t or "")):
            for k in range(order + 1):
                n[key, k, p[i + order - k : i + order + 1]] += 1
                per[key, k, p[i + order - k : i + order]] += 1
                total[key, k] += 1
    cost = Counter()
    for (key, k, g), m in n.items():
        cost[key, k] += m * math.log2(per[key, k, g[:-1]] / m)
    contexts = Counter((key, k) for key, k, _ in per)
    want = {x: (total[x], contexts[x], round(cost[x] / total[x], 5)) for x in total}
    rows = spark.createDataFrame(TEXTS, "k string, t string").coalesce(1)
    for batch in ("1", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = grams.ladder(rows, ["k"], "t", order).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        assert {(r["k"], r["ctx_order"]): (r["n_symbols"], r["n_contexts"], round(r["bits"], 5)) for r in got} == want


def test_one_pass_and_a_row_a_bucket(spark):
    """The plan read the texts once for each order, and exchanged a row for each gram of a batch."""
    plan = catalogue.queries()["order_ladder"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and plan.count("MapInArrow") == 1 and "Union" not in plan
