"""What the operators of this package share: tables, shared storage, joins that stand hot keys."""

from __future__ import annotations

import atexit
import functools
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_dir as shared_dir
from ..sources.tables import table as table

#: Rows of a few narrow columns that may be broadcast (about 16 MB); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of one Arrow batch that goes to a Python worker.
BATCH_BYTES = 8 << 20

#: Tables that results may still read; they go when Python ends.
_OPEN: dict[str, SparkSession] = {}
_SCOPE = threading.local()


def _delete(path: str) -> None:
    spark = _OPEN.pop(path, None)
    if spark is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_OPEN):
        try:
            _delete(path)
        except Exception:  # the JVM has ended before us
            return


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and reread from the shared folder: cuts the lineage and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _OPEN[path] = spark
    if getattr(_SCOPE, "paths", None) is not None:
        _SCOPE.paths.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A stretch of work whose stored tables all go at its end, but those that are given to what it yields."""
    outer, _SCOPE.paths, kept = getattr(_SCOPE, "paths", None), [], []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.stored_at)
        return df

    try:
        yield keep
    finally:
        made, _SCOPE.paths = _SCOPE.paths, outer
        for path in made:
            if path in kept:
                if outer is not None:
                    outer.append(path)
            else:
                _delete(path)


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        _delete(getattr(t, "stored_at", ""))


def shielded(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose own columns begin with two underscores, for tables with any column names: such ones are renamed meanwhile."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **named) -> DataFrame:
        other = {c: f"column {k} {c.lstrip('_')}" for k, c in enumerate(docs.columns) if c.startswith("__")}
        if not other:
            return operator(docs, *args, **named)
        told = lambda x: other.get(x, x) if isinstance(x, str) else x
        out = operator(docs.withColumnsRenamed(other), *map(told, args), **{k: told(x) for k, x in named.items()})
        return out.withColumnsRenamed({v: k for k, v in other.items()})

    return run


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes too, so that long texts do not swell a Python worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key, str(2**31 - 1))).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a stored table of narrow rows has at most so many; reads Parquet footers only."""
    return df.count() <= rows


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint where its counted size allows it, else for a shuffled join."""
    return F.broadcast(df) if small_enough(df, rows) else df


def run_id(runs: int = 256) -> Column:
    """A salt: the reading partition, so that rows of one task with one key still combine. To be stored or aggregated at once."""
    return (F.spark_partition_id() % runs).cast("int")


def row_salt(df: DataFrame, *without: str, runs: int = 256) -> Column:
    """A salt that a row gives itself, for rows that are not stored: equal each time they are computed."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if f.name not in without and not f.dataType.simpleString().startswith(("map", "variant"))]
    return F.pmod(F.xxhash64(F.lit(0), *plain), F.lit(runs)).cast("int")


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], run: str = "run") -> DataFrame:
    """Left join of rows (keys, run, ...) with groups (keys, ...), one row a key, where one key may have any share.

    A group's row is first copied to the runs that hold its key, a few hundred at most; rows
    then join on (keys, run), so a hot key is spread over all runs.
    """
    copies = rows.select(*keys, run).distinct().join(groups, keys)
    return rows.join(copies, [*keys, run], "left")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def constant(values: Iterable, kind: str, mark: str = ",") -> Column:
    """An array that the optimizer folds to one literal: thousands of numbers cost the plan one node."""
    return F.split(F.lit(mark.join(map(str, values))), mark).cast(f"array<{kind}>")


CHUNK, LEVELS = 64, 2


def running(values: str, level: int = LEVELS) -> str:
    """SQL: of an array of ints the sums of what came before each, within chunks of CHUNK, then over the chunks' sums, and so on.

    An accumulator that grows is copied at each step, so only chunks have one: time is linear in the array. (As SQL
    text, since each nested lambda of the Python API costs the driver many calls.)
    """
    plain = lambda v: f"aggregate({v}, named_struct('at', 0, 'out', cast(array() as array<int>)), (s, x) -> named_struct('at', s.at + x, 'out', concat(s.out, array(s.at))), s -> s.out)"
    if not level:
        return plain(values)
    v, c, p, a, t, y = (f"{k}{level}" for k in "vcpaty")
    chunks = f"transform(sequence(0, int((size({v}) - 1) div {CHUNK})), {c} -> slice({v}, {c} * {CHUNK} + 1, {CHUNK}))"
    tops = running(f"transform({p}, {y} -> aggregate({y}, 0, (s, x) -> s + x))", level - 1)
    joined = f"flatten(zip_with({p}, {tops}, ({a}, {t}) -> transform({plain(a)}, {y} -> {y} + {t})))"
    return f"transform(array({values}), {v} -> if(size({v}) = 0, cast(array() as array<int>), transform(array({chunks}), {p} -> {joined})[0]))[0]"


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links of longs to (u, v): each linked node but the smallest, with the smallest of its component.

    Alternating large-star and small-star rounds (Kiveris et al., 2014); every round is written to
    the shared folder. Hubs are joined by key, which adaptive execution splits; no list of a
    node's neighbours is ever gathered.
    """
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "links")
    seen = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h")).first()
        if state["n"] == 0 or seen == tuple(state):
            return e
        seen, last = tuple(state), e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        forget(last, large)
