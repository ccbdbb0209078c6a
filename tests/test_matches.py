"""Sums over matches by a sort of numbers with their places: against last places one by one."""

import numpy as np
import pytest

from loamspark.operators import counting, repeats
from loamspark.plans import context_queries


def slow(t, k, stride):
    n = matched = gap = 0
    last = {}
    for i in range(len(t) - (k - 1) * stride):
        g = t[i : i + (k - 1) * stride + 1 : stride]
        n += 1
        if g in last:
            matched, gap = matched + 1, gap + i - last[g]
        last[g] = i
    return n, matched, gap


@pytest.mark.parametrize("t", ("", "a", "abcd", "abab" * 50, "The CAT 12 the cat 345 " * 9, "🙂é日" * 30, "x" * 700, "".join(chr(33 + i * i % 4001) for i in range(2500))))
def test_sums(t):
    for k, stride in ((4, 1), (5, 2), (12, 1)):
        assert repeats.match_sums(counting.gram_ids(counting.codes(t), k, stride)) == slow(t, k, stride)


def test_large_numbers():
    ids = np.array([(1 << 62) - 1, 5, (1 << 62) - 1, 5, 5, 7])
    assert repeats.match_sums(ids) == (6, 3, 2 + 2 + 1)


def test_views(spark):
    text = "The CAT 12 the cat 34; É é @[`{ /: " * 8
    fold = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    classes = "".join("a" if "a" <= c <= "z" else "0" if "0" <= c <= "9" else c for c in fold)
    views = {"folded": (repeats.folded, 5, 1), "plain": (None, 4, 1), "stride2": (repeats.folded, 5, 2), "classes": (repeats.letter_classes, 12, 1)}
    rows = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    got = rows.select(repeats.matches_by_view(rows["t"], views).alias("m")).collect()
    want = {"folded": slow(fold, 5, 1), "plain": slow(text, 4, 1), "stride2": slow(fold, 5, 2), "classes": slow(classes, 12, 1)}
    assert {k: tuple(got[0]["m"][k]) for k in views} == want and got[1]["m"] is None and tuple(got[2]["m"]["plain"]) == (0, 0, 0)
    assert context_queries.K == 9
