"""Entropies of high orders by stretches of text: against a plain recount, on odd texts, and with few rows exchanged."""

import math
from collections import Counter

import numpy as np
import pytest

from loamspark.operators import counting, grams

TEXTS = [("a", "the cat and the dog and the cat " * 30), ("a", "x" * 1500), ("a", ""), ("b", None), ("b", "日本語" * 50 + "the cat"), (None, "a"), ("a", "".join(chr(300 + i * 7 % 5000) for i in range(3000))), ("b", "the cat and the dog " * 20), ("a", "\x02\x02a\U0010ffff")]


def plain(order):
    n = {}
    for key, t in TEXTS:
        p = "\x02" * order + (t or "")
        for i in range(len(t or "")):
            n.setdefault(key, Counter())[p[i : i + order], p[i + order]] += 1
    out = {}
    for key, grams_ in n.items():
        per = Counter()
        for (ctx, _), k in grams_.items():
            per[ctx] += k
        total = sum(per.values())
        out[key] = total, len(per), round(sum(k * -math.log2(k / per[ctx]) for (ctx, _), k in grams_.items()) / total, 5)
    return out


@pytest.mark.parametrize("order", (2, 8, 11, 14))
@pytest.mark.parametrize("bucket", (40, grams.BUCKET))
def test_entropy(spark, monkeypatch, order, bucket):
    monkeypatch.setattr(grams, "BUCKET", bucket)
    rows = grams.entropy(spark.createDataFrame(TEXTS, "k string, t string"), ["k"], "t", order).collect()
    assert {r["k"]: (r["n_symbols"], r["n_contexts"], round(r["bits"], 5)) for r in rows} == plain(order)


def test_a_large_bucket_is_sorted_in_parts(monkeypatch):
    texts = [t for _, t in TEXTS if t]
    pieces = grams.stretches(texts, 8, 1)
    code, length = counting.codes("".join(pieces[1])), np.frombuffer(b"".join(pieces[2]), np.uint8).astype(np.int64)
    whole = grams.cost(code, length, 8)
    monkeypatch.setattr(grams, "SORTED", 100)
    parts = grams.cost(code, length, 8)
    assert whole[:2] == parts[:2] and abs(whole[2] - parts[2]) < 1e-6 and whole[0] == sum(map(len, texts))


def test_grams_travel_together():
    """A row for each distinct gram was over 30 bytes for most characters; stretches hold several new ones each."""
    rng = np.random.default_rng(1)
    text = "".join(chr(97 + c) for c in rng.integers(0, 20, 100_000))
    bucket, texts, length = grams.stretches([text], 14, 64)
    assert len(set(bucket.tolist())) == len(bucket) <= 64
    assert sum(map(len, texts)) + sum(map(len, length)) < 6 * len(text)
