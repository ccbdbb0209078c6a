"""Ordered state per key, in two levels: within chunks of the order column, then over the chunks' totals.

A key that holds a large share of all rows is many chunks, and only a row for each chunk meets in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096


def running(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column], chunk: int = CHUNK) -> DataFrame:
    """df with running sums of what came before each row (exclusive), by keys in the order of a long column."""
    rows = df.withColumn("__chunk", F.floor(F.col(order) / chunk)).withColumns({f"__v_{k}": v.cast("bigint") for k, v in sums.items()})
    by = [*keys, "__chunk"]
    inner = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"__in_{k}": F.coalesce(F.sum(f"__v_{k}").over(inner), F.lit(0)) for k in sums})
    totals = rows.groupBy(*by).agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in sums])
    outer = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*by, *[F.coalesce(F.sum(f"__t_{k}").over(outer), F.lit(0)).alias(f"__b_{k}") for k in sums])
    out = rows.join(before, by)
    return out.select(*df.columns, *[(F.col(f"__in_{k}") + F.col(f"__b_{k}")).alias(k) for k in sums])


def ema(df: DataFrame, keys: list[str], order: str, value: str, rates: dict[str, float], chunk: int = CHUNK) -> DataFrame:
    """keys, n and for each rate the last exponential mean, begun at 0: e + rate * (x - e).

    A chunk is an affine map e -> keep * e + add; maps of a key are composed in order.
    """
    item = F.struct(F.col(order), F.col(value).cast("double").alias("x"))
    chunks = df.groupBy(*keys, F.floor(F.col(order) / chunk).alias("__chunk")).agg(F.sort_array(F.collect_list(item)).alias("__x"))
    fold = lambda rate: F.aggregate("__x", F.lit(0.0), lambda e, s: e + (s["x"] - e) * rate)
    maps = chunks.select(*keys, F.struct("__chunk", F.size("__x").alias("n"), *[fold(r).alias(k) for k, r in rates.items()]).alias("__m"))
    per = maps.groupBy(*keys).agg(F.sort_array(F.collect_list("__m")).alias("__m"))
    whole = lambda k, rate: F.aggregate("__m", F.lit(0.0), lambda e, m: e * F.pow(F.lit(1 - rate), m["n"]) + m[k])
    return per.select(*keys, F.aggregate("__m", F.lit(0).cast("bigint"), lambda s, m: s + m["n"]).alias("n"), *[F.round(whole(k, r), 6).alias(k) for k, r in rates.items()])


def lagged(df: DataFrame, keys: list[str], order: str, value: str, k: int, chunk: int = CHUNK) -> DataFrame:
    """df with lag1 .. lagk of value, by keys in the order of a long column: within chunks, and from the ends of the chunks before."""
    rows = df.withColumn("__chunk", F.floor(F.col(order) / chunk))
    by = [*keys, "__chunk"]
    w = Window.partitionBy(*by).orderBy(order)
    rows = rows.withColumns({"__at": F.row_number().over(w)} | {f"__in{j}": F.lag(value, j).over(w) for j in range(1, k + 1)})
    items = F.sort_array(F.collect_list(F.struct(order, F.col(value).alias("x"))))  # a chunk's rows, at most
    ends = df.withColumn("__chunk", F.floor(F.col(order) / chunk)).groupBy(*by).agg(F.transform(F.slice(items, -F.least(F.lit(k), F.size(items)), k), lambda s: s["x"]).alias("__end"))
    # k chunks have k rows at least
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(-k, -1)
    carried = ends.select(*by, F.reverse(F.flatten(F.collect_list("__end").over(before))).alias("__carry"))
    out = rows.join(carried, by)
    lags = [F.when(F.col("__at") > j, F.col(f"__in{j}")).otherwise(F.get("__carry", F.lit(j) - F.col("__at"))).alias(f"lag{j}") for j in range(1, k + 1)]
    return out.select(*df.columns, *lags)


def islands(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Runs of one value within keys: keys, value, length. Runs are numbered by a running sum in two levels."""
    rows = lagged(df.select(*keys, order, value), keys, order, value, 1)
    new = F.when(F.col("lag1") == F.col(value), 0).otherwise(1)
    rows = running(rows.withColumn("__new", new), keys, order, {"__before": F.col("__new")})
    return rows.groupBy(*keys, (F.col("__before") + F.col("__new")).alias("__run"), value).agg(F.count("*").alias("length")).drop("__run")
