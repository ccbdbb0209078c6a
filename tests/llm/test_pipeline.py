"""run() against plain Python, stage by stage."""

from collections import defaultdict

import corpus_pipeline
import sentencepiece
from pyspark.sql import functions as F
from loamspark.llm import decontaminate, pieces

from .test_near import slow_components

TINY = "/root/testdata/sf0.001"


def test_run(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()}
    items = {str(r["item_id"]): r["text"] for r in spark.read.parquet(f"{TINY}/benchmark.parquet").collect()}
    left = {i: r["text"] for i, r in docs.items() if any(c.isalpha() for c in r["text"] or "")}
    groups = defaultdict(list)
    for i, t in left.items():
        groups["".join(c for c in t if c not in "\x20\t\n\x0b\x0c\r")].append((-len(t), i))
    left = {i: left[i] for i in (min(g)[1] for g in groups.values())}
    comps = dict(slow_components(list(left.items())))
    left = {i: t for i, t in left.items() if comps[i] == i}
    hit = decontaminate.brute(left, items)
    left = {i: t for i, t in left.items() if not hit[i][2]}
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, TINY).collect()}
    assert out.keys() == left.keys()
    for i, t in left.items():
        assert out[i]["ids"] == library.encode(t) and out[i]["source"] == docs[i]["source"]


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, TINY).columns == docs.columns


def run_on(spark, tmp_path, docs, bench):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(tmp_path)).collect()


BENCH = "item_id long, text string"


def test_awkward(spark, tmp_path, awkward):
    """Nulls, empty, long and repeated texts, and columns whose names the stages use themselves."""
    extra = awkward.withColumns({c: F.lit(None).cast("string") for c in ("__own", "__gone", "__kept", "__found", "item_ids", "component_id", "keep_id")})
    out = run_on(spark, tmp_path, extra, spark.createDataFrame([(1, "one two three four five six seven eight x")], BENCH))
    # 1, 5, 5 and the one without an id are equal and hold a benchmark window; 10, 2, 3, 4 have no letter
    assert sorted(r["doc_id"] for r in out) == [6, 7, 8, 9]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, extra, str(tmp_path)).columns == extra.columns, name


def test_empty(spark, tmp_path, no_docs):
    assert run_on(spark, tmp_path, no_docs, spark.createDataFrame([], BENCH)) == []


def test_ties_and_repeated_rows(spark, tmp_path):
    text = "some words that nobody else has written in this order at all today"
    rows = [(k, text, "en", "s", len(text)) for k in (5, 3, 3, 9)] + [(None, "another text altogether", "en", "s", 23)] * 2
    out = run_on(spark, tmp_path, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame([(1, None)], BENCH))
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in out) == [(False, 3), (True, None)]
