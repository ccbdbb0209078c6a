"""Archives: files packed as coded blocks in Parquet, with a header that is checked when it is read.

A file's content is coded if decoding gives it back, else stored as it is; so whatever is written can be extracted. Writing,
extracting and comparing are one pass each, without a shuffle but for the join of a comparison.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an archive begins with.
MAGIC, VERSION = "loam", 1
PACKED = "struct<codec:string,payload:binary>"


def _pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for contents in batches:
        rows = []
        for c in contents.to_pylist():
            packed = zlib.compress(c or b"", 6)
            good = zlib.decompress(packed) == (c or b"") and len(packed) < len(c or b"")
            rows.append({"codec": "zlib", "payload": packed} if good else {"codec": "none", "payload": c or b""})
        yield pa.array(rows, pa.struct([("codec", pa.string()), ("payload", pa.binary())]))


def _unpack(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for codec, payload in batches:
        yield pa.array([zlib.decompress(p) if c == "zlib" else p for c, p in zip(codec.to_pylist(), payload.to_pylist(), strict=True)], pa.binary())


def write(files: DataFrame, path: str, level: int = 6) -> None:
    """Files (path, content) as an archive; null contents are empty ones. An archive that is there is not touched: that raises."""
    spark = files.sparkSession
    rows = files.select("path", F.coalesce("content", F.lit(b"")).alias("content"))
    packed = rows.select("path", F.octet_length("content").cast("bigint").alias("size"), F.sha2("content", 256).alias("sha256"), F.arrow_udf(_pack, PACKED)(F.col("content")).alias("p"))
    packed.select("path", "size", "sha256", "p.codec", "p.payload").write.parquet(f"{path}/blocks")
    spark.createDataFrame([(MAGIC, VERSION, level)], "magic string, version int, level int").coalesce(1).write.parquet(f"{path}/header")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of an archive whose header is right."""
    head = spark.read.parquet(f"{path}/header").collect()
    if len(head) != 1 or head[0]["magic"] != MAGIC:
        raise ValueError(f"{path} is no archive")
    if head[0]["version"] != VERSION:
        raise ValueError(f"{path} is an archive of version {head[0]['version']}")
    return spark.read.parquet(f"{path}/blocks")


def contents(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256, codec, packed: the catalogue; no payload is read but for its length."""
    return blocks(spark, path).select("path", "size", "sha256", "codec", F.octet_length("payload").cast("bigint").alias("packed"))


def extract(spark: SparkSession, path: str) -> DataFrame:
    """path, content."""
    return blocks(spark, path).select("path", F.arrow_udf(_unpack, "binary")(F.col("codec"), F.col("payload")).alias("content"))


def compare(files: DataFrame, path: str) -> DataFrame:
    """path, verdict of files against an archive: equal, different, or only on one side. Digests are joined, not contents."""
    mine = files.select("path", F.sha2(F.coalesce("content", F.lit(b"")), 256).alias("mine"))
    theirs = extract(files.sparkSession, path).select("path", F.sha2("content", 256).alias("theirs"))
    verdict = F.when(F.col("mine").isNull(), "only in the archive").when(F.col("theirs").isNull(), "only in the files").when(F.col("mine") == F.col("theirs"), "equal").otherwise("different")
    return mine.join(theirs, "path", "full").select("path", verdict.alias("verdict"))
