import random
from collections import Counter

import corpus_pipeline
from loamspark.llm import near

SMALL = "/root/testdata/sf0.01"


def slow_components(rows):
    """doc_id -> component over all pairs with five-word Jaccard of 0.8 or more."""
    sets = []
    for _, t in rows:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
        sets.append(frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    up = {s: s for s in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    nodes = list(up)
    for k, a in enumerate(nodes):
        for b in nodes[k + 1 :]:
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                up[top(b)] = top(a)
    low = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if i is not None:
            low[top(s)] = min(i, low.get(top(s), i))
    return [(i, low.get(top(s))) for (i, _), s in zip(rows, sets, strict=True)]


def test_near_copies_go(spark):
    """Copies at 0.8 to 0.95 of 100, 300 and 1000 words go; at less than 0.7 they stay."""
    rng = random.Random(3)
    rows = []
    for size in (100, 300, 1000):
        for share in (0.01, 0.02, 0.08):
            base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            copy = list(base)
            for k in range(int(size * share)):
                copy[(k * size) // int(size * share)] = f"x{rng.randrange(10**6)}"
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {c for _, c in slow_components(rows)}
    assert len(want) == 12
    assert {r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, SMALL).collect()} == want


def test_crowd_chain_and_table(spark):
    """A crowd around one text, a chain whose ends are unlike, and a whole table, against all pairs."""
    rng = random.Random(4)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    base = [f"w{k}" for k in range(200)]
    for k in range(150):
        copy = list(base)
        for at in rng.sample(range(200), rng.choice((1, 2, 4, 8))):
            copy[at] = f"y{k}"
        rows.append((10**6 + k, " ".join(copy)))
    rows += [(2 * 10**6 + k, " ".join(f"c{j}" for j in range(8 * k, 8 * k + 100))) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = near.similar_groups(docs).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in out) == Counter(slow_components(rows))


def test_awkward_and_empty(spark, awkward, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    out = near.similar_groups(awkward).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in out) == Counter(slow_components(rows))
    assert near.drop_similar(no_docs).collect() == []
    assert near.drop_similar(awkward).columns == awkward.columns


def test_pivot_distances_alone_find_a_link(spark):
    """Without any band, texts whose fingerprints differ by 2 bits or less meet by pivot distances; whole sets decide, so equal fingerprints of unlike texts do not link."""
    words = [f"w{k}" for k in range(1000)]
    texts = {1: " ".join(words), 2: " ".join([*words[:-1], "other"]), 3: " ".join(f"z{k}" for k in range(1000))}
    sets = {i: near.shingles(t) for i, t in texts.items()}
    prints = {i: near.majority(s) for i, s in sets.items()}
    assert 0 < (prints[1] ^ prints[2]).bit_count() <= 2
    prints[3] = prints[1]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = [(i, signed(near.node_of(sets[i])), signed(prints[i]), []) for i in texts]
    tops = near.near_tops(docs, spark.createDataFrame(rows, "doc_id long, node long, fp long, keys array<long>"), "doc_id", "text").collect()
    assert [{r["node"], r["top"]} for r in tops] == [{rows[0][1], rows[1][1]}]


def test_texts_are_read_by_one_python_node(spark, monkeypatch):
    """A second one doubles an executor's Python workers, which stay for the stages that follow."""
    plans, real = {}, near.stored
    monkeypatch.setattr(near, "stored", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), real(df, name))[1])
    near.similar_groups(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert {name: n for name, plan in plans.items() if (n := plan.count("ArrowEvalPython"))} == {"near-prints": 1, "near-sets": 1}
