"""Exact dedup [native]: tree-merge of sorted digest runs.

Every input partition yields a run of (digest, best row, rows), sorted. In each round FAN_IN neighbours (four binomial rounds at once) exchange
their runs by ranges of (run, digest), so that a merged run lies sorted over as many tasks as it needs and no task holds a whole
one; a sort-based aggregation merges the parts and keeps of a digest the verified best row and the sum of the rows.
Rounds go on until one run is left, however many there were. The result goes back down the runs.

Defined cases: null text is the empty text; texts without any character but white space are
equal; of rows that tie in length and doc_id (repeated rows) exactly one stays; a null doc_id
comes after all others; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, run_id, scratch, shielded, sized, stored, table

SPACE = "[\\x20\\x09-\\x0D]+"
FAN_IN = 16
#: Equal means: equal SHA-256 of the normalised text, verified by its XXH64 and its length in bytes.
KEY = ["digest", "check", "size"]


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A narrow row for each document, written once: no text is ever shuffled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), F.regexp_replace(text, SPACE, "").alias("n"))
    return stored(
        rows.select(
            "doc_id",
            F.length("t").cast("long").alias("chars"),
            F.xxhash64("t").alias("text_hash"),
            F.unhex(F.sha2("n", 256)).alias("digest"),
            F.xxhash64("n").alias("check"),
            F.octet_length("n").alias("size"),
            F.monotonically_increasing_id().alias("row"),
            F.spark_partition_id().alias("run"),
        ),
        "signatures",
    )


def merged(sig: DataFrame) -> DataFrame:
    """KEY, best (its doc_id, chars and row), rows: the root of the merge tree."""
    best = F.struct((-F.col("chars")).alias("minus"), F.col("doc_id").isNull().alias("absent"), "doc_id", "row")
    runs = (sig.agg(F.max("run").alias("run")).first()["run"] or 0) + 1
    level = sig.groupBy("run", *KEY).agg(F.min(best).alias("best"), F.count("*").alias("rows"))
    while runs > 1:
        runs = -(-runs // FAN_IN)
        level = level.withColumn("run", F.floor(F.col("run") / FAN_IN).cast("int")).repartitionByRange("run", *KEY)
        level = level.groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("rows").alias("rows"))
    return level.select(*KEY, F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "rows")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256; and chars, text_hash to find its row."""
    sig = signatures(docs, id_col, text_col)
    return attach(sig, merged(sig), KEY).select(
        "doc_id",
        "keep_id",
        F.col("rows").cast("long").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "chars",
        "text_hash",
    )


def _marks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """__mark (doc_id, length and hash of a row's text), kept: of rows that go, and of those of which one of several stays."""
    found = stored(exact_groups(docs, id_col, text_col).where("group_size > 1").select("doc_id", "chars", "text_hash", "kept"), "exact-groups")
    same = ["doc_id", "chars", "text_hash"]
    marks = found.groupBy(*same).agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    return stored(marks.where("not kept or rows > 1").select(F.struct(*same).alias("__mark"), "kept"), "exact-marks")


@shielded
def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with its own columns, without the rows that exact_groups does not keep."""
    with scratch() as keep:
        marks = keep(_marks(docs, id_col, text_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.withColumn("__own", F.struct(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("chars"), F.xxhash64(text).alias("text_hash")))
    joined = named.join(sized(marks.withColumnRenamed("kept", "__kept")), F.col("__own") == F.col("__mark"), "left")
    if marks.where("kept").isEmpty():
        out = joined.where("__kept is null")
    else:  # repeated rows: all but one of each go
        repeated = joined.where("__kept").withColumn("__run", run_id())
        one = repeated.groupBy("__own", "__run").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("__row"))
        one = one.groupBy("__own").agg(F.first("__row").alias("__row"))
        out = joined.where("__kept is null").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(one.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = {
    "op7_exact_dedup": r"""
with d as (
  select doc_id, coalesce(text, '') as t,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as h
  from documents)
select doc_id,
       first_value(doc_id) over w as keep_id,
       count(*) over (partition by h) as group_size,
       row_number() over w = 1 as kept,
       h as text_sha256
from d
window w as (partition by h order by length(t) desc, doc_id
             rows between unbounded preceding and unbounded following)
"""
}
