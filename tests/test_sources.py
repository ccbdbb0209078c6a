"""Sources, sinks and streams on small files of their own."""

import datetime
import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loamspark.operators import sequences as S
from loamspark.sources import tables
from loamspark.streaming import counts


class Cluster:
    class conf:
        @staticmethod
        def get(key, default):
            return default

    def __init__(self, master):
        self.sparkContext = type("Context", (), {"master": master})


def test_a_cluster_must_name_its_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            tables.shared_dir(Cluster(master))


def test_files_and_logs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"\x00\xff")
    (tmp_path / "in" / "b.txt").write_bytes(b"text")
    rows = {r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in tables.files(spark, str(tmp_path / "in"), "*.bin").collect()}
    assert rows == {"a.bin": b"\x00\xff"}
    run = spark.createDataFrame([("x", 5)], "input_filename string, original_size_bytes long")
    for _ in range(2):
        tables.append_log(run, str(tmp_path / "log"))
    assert spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "log")).count() == 2


def test_manifest_refuses_absolute_paths(spark):
    lines = spark.createDataFrame([(0, "header\tx"), (1, "a/b.txt\t1"), (2, "/etc/passwd\t2"), (3, "C:\\x"), (4, ""), (5, "c")], "n long, line string")
    assert [r["path"] for r in tables.manifest(lines).orderBy("n").collect()] == ["a/b.txt", "c"]


def test_late_events(spark, tmp_path):
    """Events within the watermark's delay change their hour; later ones are dropped with its state."""
    day = lambda d, h: datetime.datetime(2024, 1, d, h, 30)
    batches = [[(day(1, 0), "a"), (day(1, 1), "a")], [(day(1, 20), "a"), (day(1, 0), "a")], [(day(5, 0), "a")], [(day(5, 0), "a")], [(day(1, 0), "a"), (day(5, 0), "a")]]
    src = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "ts timestamp, event_type string").coalesce(1).write.parquet(f"{src}/{k}")
        part = next((src / str(k)).glob("*.parquet"))
        part.rename(src / f"{k}.parquet")
    for k in range(len(batches)):
        os.utime(src / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema("ts timestamp, event_type string").option("maxFilesPerTrigger", 1).option("pathGlobFilter", "[0-9].parquet").parquet(str(src))
    out = counts.drained(spark, counts.hourly(stream), "late", ["hour", "event_type"], "n")
    got = {(r["hour"].day, r["hour"].hour): r["n"] for r in out.collect()}
    assert got == {(1, 0): 2, (1, 1): 1, (1, 20): 1, (5, 0): 3}


def test_histories_do_not_end_at_midnight(spark):
    """Lags, runs and contexts over chunk boundaries: the same as over one ordered window."""
    rows = spark.range(500).selectExpr("id", "id % 3 as user", "cast(hash(id div 3) % 3 as string) as v")
    w = Window.partitionBy("user").orderBy("id")
    want = {tuple(r) for r in rows.select("id", *[F.lag("v", k).over(w).alias(f"lag{k}") for k in (1, 2, 7)]).collect()}
    got = S.lagged(rows, ["user"], "id", "v", 7, chunk=16)
    assert {tuple(r) for r in got.select("id", "lag1", "lag2", "lag7").collect()} == want
