import random
from collections import Counter

import pytest
import xxhash

from loamspark.llm import common, simhash

SMALL = "/root/testdata/sf0.01"


def slow_print(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints):
    """doc_id -> component over all pairs of distinct fingerprints."""
    nodes = sorted({p for _, p in prints})
    up = {p: p for p in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(nodes):
        for b in nodes[k + 1 :]:
            if (a ^ b).bit_count() <= 2:
                up[top(b)] = top(a)
    low = {}
    for i, p in prints:
        if i is not None:
            low[top(p)] = min(i, low.get(top(p), i))
    return [(i, low.get(top(p))) for i, p in prints]


def test_whole_table(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    prints = [(i, slow_print(t)) for i, t in texts]
    out = simhash.op2_simhash(spark, SMALL).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in out} == {i: f"{p:016x}" for i, p in prints}
    assert Counter((r["doc_id"], r["component_id"]) for r in out) == Counter(slow_components(prints))


def test_awkward_and_empty(spark, awkward, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    out = simhash.near_groups(awkward).collect()
    want = slow_components([(i, slow_print(t)) for i, t in rows])
    assert Counter((r["doc_id"], r["component_id"]) for r in out) == Counter(want)
    assert simhash.near_groups(no_docs).collect() == []
    assert simhash.drop_near(no_docs).collect() == []
    kept = simhash.drop_near(awkward)
    assert kept.columns == awkward.columns


def test_links_of_crowded_buckets(spark):
    """Hundreds of fingerprints around one centre, and chains: no link may be lost."""
    rng = random.Random(5)
    prints = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(120):
            x = centre
            for b in rng.sample(range(64), rng.choice((1, 1, 2, 3, 4))):
                x ^= 1 << b
            prints.add(x)
    chain = rng.getrandbits(64)
    for b in range(0, 60, 2):
        prints.add(chain)
        chain ^= 3 << b
    prints |= {rng.getrandbits(64) for _ in range(300)}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    nodes = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    tops = common.components(simhash.links(simhash.pivot_buckets(nodes)))
    got = {r["u"] % 2**64: r["v"] % 2**64 for r in tops.collect()}
    ids = {x: k for k, x in enumerate(sorted(prints))}
    want = dict(slow_components([(ids[x], x) for x in prints]))
    groups, groups_want = {}, {}
    for x in prints:
        groups.setdefault(got.get(x, x), set()).add(x)
        groups_want.setdefault(want[ids[x]], set()).add(x)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in groups_want.values()}


def test_one_of_each_component_stays(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = simhash.drop_near(docs)
    assert kept.columns == docs.columns
    want = {c for _, c in slow_components([(r["doc_id"], slow_print(r["text"])) for r in docs.collect()])}
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == want


def test_nothing_but_the_result_is_left(spark, tmp_path, monkeypatch):
    """Rounds and tables go as soon as nothing reads them; the result's own table goes with the session."""
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    out = simhash.near_groups(spark.read.parquet(f"{SMALL}/documents.parquet"))
    left = sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir())
    assert left == ["near-groups"]
    assert out.count() == 1000


class Cluster:
    """What shared_dir reads of a session."""

    class conf:
        @staticmethod
        def get(key, default):
            return default

    def __init__(self, master):
        self.sparkContext = type("Context", (), {"master": master})


def test_a_cluster_must_name_its_folder():
    for master in ("spark://host:7077", "yarn", "k8s://https://host", "local-cluster[3,1,1024]"):
        with pytest.raises(RuntimeError):
            common.shared_dir(Cluster(master))
