"""Scalar mathematics as Column expressions: logits, logarithms, bit counts, circular distance, variable-length costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Logits are held within these bounds.
LOGIT = 8.0


def stretch(p: Column) -> Column:
    """ln(p / (1 - p)), within +-LOGIT also where p is 0 or 1."""
    inner = F.when(p <= 0, F.lit(-LOGIT)).when(p >= 1, F.lit(LOGIT)).otherwise(F.log(p / (F.lit(1.0) - p)))
    return F.greatest(F.lit(-LOGIT), F.least(F.lit(LOGIT), inner))


def squash(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def bits(x: Column) -> Column:
    """Binary digits of a non-negative long: 0 for 0."""
    return F.when(x <= 0, F.lit(0)).otherwise(F.length(F.bin(x)))


def ilog2(x: Column) -> Column:
    """Whole binary logarithm; 0 for 0."""
    return F.greatest(F.lit(0), bits(x) - 1)


def log_scaled(x: Column, scale: int = 16) -> Column:
    """log2(x) * scale, rounded; 0 for 0."""
    return F.when(x <= 0, F.lit(0)).otherwise(F.round(F.log2(x) * scale).cast("int"))


def circular(a: Column, b: Column) -> Column:
    """Distance of two bytes on a circle of 256."""
    return F.least(F.abs(a - b), F.lit(256) - F.abs(a - b))


def paeth(left: Column, up: Column, corner: Column) -> Column:
    """Of three neighbours that nearest to left + up - corner; ties go to the left, then the upper one."""
    a, b, c = F.abs(up - corner), F.abs(left - corner), F.abs(left + up - corner * 2)
    return F.when((a <= b) & (a <= c), left).when(b <= c, up).otherwise(corner)


def vli_cost(x: Column) -> Column:
    """Bytes of a non-negative long at 7 bits a byte."""
    return F.greatest(F.lit(1), F.ceil(bits(x) / F.lit(7))).cast("int")


def leading_zeros(x: Column, width: int = 32) -> Column:
    return F.lit(width) - bits(x)


def cost(p: Column) -> Column:
    """Bits that a symbol of probability p costs."""
    return -F.log2(p)
