"""Words of a batch at once, pairs of their slices, and the language rule: against the plain ways, on odd texts."""

from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loamspark.functions import stems
from loamspark.operators import counting as C

ODD = ["", None, "A b", "b", "", "'-'", "x" * 3, "É日本 -é\x7f\x80", "the\x00The  the", "🙂a b", " ", "end"]


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.none() | st.text(st.sampled_from("aB'- .é日\x7f\x80🙂"), max_size=12), max_size=8), skip=st.integers(0, 2), wide=st.booleans())
def test_split_words(texts, skip, wide):
    array = pa.array(texts, pa.large_string() if wide else pa.string())[skip:]
    word, known, text = C.split_words(array)
    got = [[] for _ in range(len(array))]
    for w, t in zip(word.tolist(), text.tolist(), strict=True):
        got[t].append(known[w].as_py())
    assert got == [C.words(t or "") for t in texts[skip:]]


def test_pairs_of_slices(spark):
    rows = spark.createDataFrame([(k % 3 or None, t) for k, t in enumerate(ODD)], "k int, t string")
    n, sliced, single = Counter(), Counter(), Counter()
    for k, t in enumerate(ODD):
        w = C.words(t or "")
        single.update((k % 3 or None, x) for x in w)
        for a, b in zip(w, w[1:]):
            n[k % 3 or None, a, b] += 1
            sliced[a[:1], a[-2:], b[:1]] += 1
    assert {(r["k"], r["a"], r["b"]): r["n"] for r in C.pair_counts(rows, ["k"], "t").collect()} == n
    assert {(r["i"], r["e"], r["c"]): r["n"] for r in C.pair_counts(rows, [], "t", {"i": (0, 1), "e": (-2, None)}, {"c": (0, 1)}).collect()} == sliced
    assert {(r["k"], r["word"]): r["n"] for r in C.word_counts(rows, ["k"], "t").collect()} == single


def test_slices_are_counted_before_they_are_shuffled(spark, monkeypatch):
    """Of 4,000 different pairs, one initial and one ending: a row leaves Python, not one for each pair."""
    text = " ".join(f"a{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}zz" for i in range(4000))
    df = C.pair_counts(spark.createDataFrame([(text,)], "t string"), [], "t", {"i": (0, 1), "e": (-2, None)}, {"c": (0, 1)})
    df.collect()
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString() and [tuple(r) for r in df.collect()] == [("a", "zz", "a", 3999)]


def test_told():
    rng = np.random.default_rng(0)
    for share in (0.02, 0.1, 0.3, 0.6):
        texts = [rng.random((3, int(n))) < share for n in rng.integers(1, 400, 30)]
        first = np.repeat(np.cumsum([0] + [t.shape[1] for t in texts[:-1]]), [t.shape[1] for t in texts])
        names, want = list(stems.STEMMERS)[::-1], []
        for t in texts:
            known = {k: {i: bool(t[j, i]) for i in range(t.shape[1])} for j, k in enumerate(names)}
            want += [3 if x is None else names.index(x) for x in stems.languages(list(range(t.shape[1])), known)]
        assert stems.told(np.concatenate(texts, axis=1), first).tolist() == want


def test_language_words(spark):
    texts = [*ODD, "the walking and the talking of the dogs " * 30, "und der kater und die katzen sitzen nicht " * 20 + "the dogs and the cats of the house " * 20, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(1)
    got = {r["i"]: r["m"] for r in rows.select("i", stems.language_words(rows["t"]).alias("m")).collect()}
    assert got == {i: dict(Counter(x or "none" for x in stems.languages(C.words(t or "")))) for i, t in enumerate(texts)}


def test_words_are_stemmed_once(monkeypatch):
    """By a worker, over its batches and tasks, until it knows too many of them."""
    seen = Counter()
    monkeypatch.setattr(stems, "_KNOWN", {})
    monkeypatch.setattr(stems, "KEPT_WORDS", 3)
    monkeypatch.setattr(stems, "STEMMERS", {k: lambda w, f=f: (seen.update([w]), f(w))[1] for k, f in stems.STEMMERS.items()})
    for words in (["the", "der"], ["the", "les"], ["der", "walking", "dog"], ["the"]):
        got = stems.recognised(words)
    assert got.tolist() == [[False], [False], [True]] and seen == {"the": 6, "der": 3, "les": 3, "walking": 3, "dog": 3}
