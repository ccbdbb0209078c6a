import hashlib
import re
from collections import Counter, defaultdict

from loamspark.llm import exact_dedup

SMALL = "/root/testdata/sf0.01"


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", t or "")].append((-len(t or ""), i is None, i if i is not None else 0, i))
    out = []
    for n, members in groups.items():
        members.sort()
        for k, m in enumerate(members):
            out.append((m[3], members[0][3], len(members), k == 0, hashlib.sha256(n.encode()).hexdigest()))
    return Counter(out)


def found(df):
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()])
    assert found(exact_dedup.op7_exact_dedup(spark, SMALL)) == want
    assert found(exact_dedup.exact_groups(docs.repartition(40))) == want


def test_awkward_and_empty(spark, awkward, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert found(exact_dedup.exact_groups(awkward)) == brute(rows)
    assert exact_dedup.exact_groups(no_docs).collect() == []
    kept = exact_dedup.drop_exact(awkward)
    assert kept.columns == awkward.columns
    want = Counter(k[0] for k, n in brute(rows).items() for _ in range(n) if k[3])
    assert Counter(r["doc_id"] for r in kept.collect()) == want
    assert exact_dedup.drop_exact(no_docs).collect() == []


def test_ties_and_white_space(spark):
    rows = [(9, "a b"), (3, "a b"), (4, "a  b"), (5, "ab"), (6, "a\u00a0b"), (7, "a\u00a0b"), (8, "\ta\x0b b\r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs).collect()}
    assert {r["keep_id"] for i, r in out.items() if i != 6 and i != 7} == {8}
    assert {r["keep_id"] for i, r in out.items() if i in (6, 7)} == {6}


def test_any_number_of_runs(spark):
    """600 input partitions are merged in three rounds of exchanged ranges, without a second exchange for the aggregation."""
    texts = [f"text {k % 97}" + " " * (k % 5) for k in range(1800)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(600)
    with_conf = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sig = exact_dedup.signatures(docs)
        assert sig.agg({"run": "max"}).first()[0] == 599
        root = exact_dedup.merged(sig)
        plan = root._jdf.queryExecution().executedPlan().toString()
        assert plan.count("rangepartitioning") == 3 and plan.count("Exchange hashpartitioning") == 1
        got = {(r["keep_id"], r["rows"]) for r in root.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", with_conf)
    groups = {}
    for k, t in enumerate(texts):
        groups.setdefault(t.replace(" ", ""), []).append((-len(t), k))
    assert got == {(min(g)[1], len(g)) for g in groups.values()}
