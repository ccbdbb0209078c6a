"""From raw documents to token ids: five stages, each written as Parquet and reread by the next.

A stage takes (spark, docs, sf_dir). All but the last return the columns of documents.

Defined cases: null texts and texts without a letter go in the first stage; of equal texts the longest, then the smallest
doc_id stays, and of repeated rows one; of a group of similar texts the smallest doc_id stays, and rows without a doc_id
do; a benchmark without items drops nothing; an empty table gives an empty result; columns beyond those of documents are kept
up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamspark.llm.common import forget, scratch, stored, table
from loamspark.llm.decontaminate import decontaminate
from loamspark.llm.exact_dedup import drop_exact
from loamspark.llm.language import drop_unidentified
from loamspark.llm.near import drop_similar
from loamspark.llm.pieces import tokenized


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go."""
    return drop_unidentified(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of equal documents stays."""
    return drop_exact(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones stays."""
    return drop_similar(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of any benchmark item go."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), items=1)
    return found.where("not contaminated").select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars; ids, n_tokens and exact instead of the text."""
    return tokenized(docs.select(*[F.col(c) for c in ("doc_id", "text", "lang", "source", "n_chars")]))


STAGES = [
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("sentencepiece", token_stage),
]

#: Majority bits, suffix arrays and BPE merges have no SQL form; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over what the others kept. Of their tables only that which it reads is left."""
    docs, before = table(spark, sf_dir, "documents"), ()
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            docs = keep(stored(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        forget(*before)
        before = (docs,)
    return STAGES[-1][1](spark, docs, sf_dir)
