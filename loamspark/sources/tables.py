"""Sources and sinks: tables, opaque files, manifests, the block catalogue of an archive, run logs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Opaque files: path, modificationTime, length, content. Content is read only where it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def manifest(lines: DataFrame, column: str = "line", order: str = "n") -> DataFrame:
    """Paths of a manifest: the first TAB column of each line but the header (order 0); absolute paths and empty ones are refused."""
    path = F.split(F.col(column), "\t").getItem(0)
    return lines.where(F.col(order) > 0).select(F.col(order), path.alias("path")).where(~F.col("path").rlike(r"^(/|\\|[A-Za-z]:)") & (F.col("path") != ""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One of our own only where the cluster names none and all run on this machine."""
    known = spark.conf.get("spark.checkpoint.dir", "")
    if not known:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        known = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", known)
    return known


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def append_log(df: DataFrame, path: str) -> None:
    """A run's metrics, appended as TSV lines with a header in each part."""
    df.write.mode("append").option("sep", "\t").option("header", "true").csv(path)
