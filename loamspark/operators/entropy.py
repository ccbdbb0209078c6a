"""Context statistics and what symbols cost under them.

Counts are group-bys with map-side combination; a context's total and its sum of n log2 n are all that a conditional entropy needs, so no
join and no window stands between the counts and the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conditional(counts: DataFrame, keys: list[str], ctx: list[str], n: str = "n") -> DataFrame:
    """Of distinct (keys, ctx, symbol) rows with n: keys, n_symbols, n_contexts, bits a symbol."""
    per = counts.groupBy(*keys, *ctx).agg(F.sum(n).alias("__n"), F.sum(F.col(n) * F.log2(F.col(n).cast("double"))).alias("__s"))
    total = per.groupBy(*keys).agg(F.sum("__n").alias("n_symbols"), F.count("*").alias("n_contexts"), F.sum(F.col("__n") * F.log2(F.col("__n").cast("double")) - F.col("__s")).alias("__h"))
    return total.select(*keys, "n_symbols", "n_contexts", F.round(F.col("__h") / F.col("n_symbols"), 6).alias("bits"))


def symbol_counts(df: DataFrame, keys: list[str], symbols: Column, name: str = "g") -> DataFrame:
    """Counts of the elements of an array column, by keys."""
    return df.select(*keys, F.explode(symbols).alias(name)).groupBy(*keys, name).agg(F.count("*").alias("n"))


def laplace(df: DataFrame, keys: list[str], y: str) -> DataFrame:
    """(2 n1 + 1) / (2 (n0 + n1) + 2) for a 0/1 column, by keys."""
    return df.groupBy(*keys).agg(F.count(y).alias("n"), F.sum(y).alias("n1")).withColumn("p", F.round((2 * F.col("n1") + 1) / (2 * F.col("n") + 2), 6))


def bit_probabilities(counts: DataFrame, keys: list[str], symbol: str = "b", n: str = "n", width: int = 8) -> DataFrame:
    """From a distribution over bytes to that of each next bit: keys, bit (0 first), ctx (the bits before, with a leading 1), p1."""
    rows = counts.select(*keys, symbol, n, F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("bit"))
    ctx = F.expr(f"cast(shiftright({symbol} + {1 << width}, {width} - bit) as int)")
    one = F.expr(f"shiftright({symbol}, {width - 1} - bit) & 1")
    return rows.groupBy(*keys, "bit", ctx.alias("ctx")).agg(F.sum(n).alias("n"), F.sum(F.col(n) * one).alias("n1")).withColumn("p1", F.round(F.col("n1") / F.col("n"), 6))
