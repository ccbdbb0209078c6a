import hashlib
import random
from collections import Counter

import numpy as np

from loamspark.llm import decontaminate as d

SMALL = "/root/testdata/sf0.01"


def test_whole_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    items = {str(r["item_id"]): r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    want = d.brute(docs, items)
    out = {r["doc_id"]: r for r in d.op5_decontaminate(spark, SMALL).collect()}
    assert out.keys() == docs.keys()
    for i, (n, hit, names) in want.items():
        r = out[i]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(names))
        assert r["items_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert r["contaminated"] == (len(names) >= 2)
    assert any(x[1] for x in want.values())


def test_random_texts(spark, monkeypatch):
    rng = random.Random(3)
    item = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = {str(k): item(rng.choice((1, 2, 5, 8, 9, 12, 20))) for k in range(12)} | {"99": "...", "98": ""}
    docs = {k: item(rng.randrange(0, 60)) for k in range(80)}
    a = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    b = spark.createDataFrame([*items.items(), (None, "a b c"), ("97", None)], "item_id string, text string")
    want = d.brute(docs, items)
    for size in (d.BLOCK_BYTES, 300):
        monkeypatch.setattr(d, "BLOCK_BYTES", size)
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in d.decontaminate(a, b).collect()}
        assert got == want


def test_matches_are_longest_and_verbatim(spark):
    a = spark.createDataFrame([(1, "x " + " ".join(f"w{k}" for k in range(30)) + " y")], "doc_id long, text string")
    b = spark.createDataFrame([(5, " ".join(f"W{k}" for k in range(3, 25)))], "item_id long, text string")
    r = d.decontaminate(a, b).first()
    assert [tuple(m) for m in r["matches"]] == [(4, 22, "5", 0)]
    assert r["n_hit"] == 22


def test_awkward_and_empty(spark, awkward, no_docs):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, "seven eight nine ten"), (3, None)], "item_id long, text string")
    out = d.decontaminate(awkward.withColumnRenamed("fp", "matches"), bench).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["contaminated"]) for r in out)
    want = Counter()
    for r in awkward.collect():
        n, hit, names = d.brute({0: r["text"]}, {"1": "one two three four five six seven eight", "2": "seven eight nine ten"})[0]
        want[(r["doc_id"], n, hit, len(names) >= 2)] += 1
    assert got == want
    assert d.decontaminate(no_docs, bench).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r["n_hit"] == 0 and not r["contaminated"] for r in d.decontaminate(awkward, none).collect())


def test_every_match_is_verbatim_and_maximal():
    rng = random.Random(5)
    for _ in range(60):
        text = lambda n: " ".join(rng.choice("ab") for _ in range(n))
        items = [(str(k), text(rng.choice((2, 3, 4, 6, 9, 15)))) for k in range(6)]
        test = d.TestIndex(items, 4)
        doc = d.words(text(40))
        tokens = np.array([test.vocabulary.get(w, 0) for w in doc] + [0], np.int32)
        at, kind = d.hits(tokens, test)
        want = {(p, tuple(w)) for _, t in items for w in [d.words(t)[k : k + 4] for k in range(max(1, len(d.words(t)) - 3))] for p in range(len(doc) - len(w) + 1) if doc[p : p + len(w)] == w}
        assert {(p, tuple(doc[p : p + test.length[c]])) for p, c in zip(at.tolist(), kind.tolist(), strict=True)} == want
        item_words = {name: d.words(t) for name, t in items}
        hit = set()
        for p, n, place in d.longest(at, kind, test):
            name, k = test.where(place)
            assert item_words[name][k : k + n] == doc[p : p + n]
            longer = [doc[p : p + n + 1], doc[p - 1 : p + n] if p else None]
            if n >= 4:
                assert not any(x and len(x) == n + 1 and any(w[i : i + n + 1] == x for i in range(len(w) - n)) for w in item_words.values() for x in longer)
            hit |= set(range(p, p + n))
        assert hit == {q for p, w in want for q in range(p, p + len(w))}


def test_shared_boilerplate_is_linear(spark):
    """800 items share eight words that a document repeats 800 times: 800 matches and 800 items, no product of both."""
    words = " ".join(f"w{k}" for k in range(8))
    docs = spark.createDataFrame([(1, " stop ".join([words] * 800))], "doc_id long, text string")
    bench = spark.createDataFrame([(k, f"item{k} {words} end{k}") for k in range(800)], "item_id long, text string")
    r = d.decontaminate(docs, bench).first()
    assert len(r["matches"]) == 800 and len(r["item_ids"]) == 800 and r["n_hit"] == 6400


def test_one_python_node_however_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_BYTES", 2000)
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert next(d.blocks(bench))[0] > 5
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 200")
    out = d.decontaminate(docs, bench)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 0
    want = d.brute({r["doc_id"]: r["text"] for r in docs.collect()}, {str(r["item_id"]): r["text"] for r in bench.collect()})
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in out.collect()} == want
    monkeypatch.undo()
    assert d.decontaminate(docs, bench)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_words_are_counted_alike(spark):
    """By the JVM as by the scan, between any two characters of note; and by a class without ranges, of which each costs a call for each character."""
    marks = [chr(c) for c in (*range(256), 0x2003, 0xD7FF, 0xE000, 0xFFFD, 0xFFFF, 0x10000, 0x1F642, 0x10FFFF)]
    rows = [(k, "".join(f"a{m}b{m} " for m in marks) + "".join(f"{m}{x}" for x in marks)) for k, m in enumerate(marks)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["doc_id"]: r["n_words"] for r in d.decontaminate(docs, none).collect()} == {k: len(d.words(t)) for k, t in rows}
    assert "-" not in d.WORD and d.WORD.endswith("++")
