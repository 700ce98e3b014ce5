"""Scalar and array functions on class values and distributions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_PROBABILITY = 1e-40


def bit_not(x: Column, nc: int) -> Column:
    return F.lit(nc - 1).bitwiseXOR(x)


def mod_add(a: Column, b: Column, nc: int) -> Column:
    return F.pmod(a.cast("long") + b, F.lit(nc))


def mod_sub(a: Column, b: Column, nc: int) -> Column:
    return F.pmod(a.cast("long") - b, F.lit(nc))


def mod_mul(a: Column, b: Column, nc: int) -> Column:
    return F.pmod(a.cast("long") * b, F.lit(nc))


def neutral(op: str, nc: int) -> int:
    """The value that changes nothing under the operation."""
    return {"and": nc - 1, "or": 0, "xor": 0, "add": 0, "mul": 1}[op]


def signed_bit(x: Column, i: int) -> Column:
    """Bit i - 1 of x as -1 or 1; position 0 is the intercept, 1."""
    return F.lit(1) if i == 0 else 2 * F.shiftright(x, i - 1).bitwiseAND(1) - 1


def hamming_weight(x: Column) -> Column:
    return F.bit_count(x)


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x)


def normalised(p: Column) -> Column:
    """Shares of the sum; null where the sum is 0."""
    return F.transform(p, lambda x: F.try_divide(x, total(p)))


def regularised(p: Column) -> Column:
    """Moved up to be non-negative, then shares of the sum."""
    low = F.least(F.array_min(p), F.lit(0.0))
    return normalised(F.transform(p, lambda x: x - low))


def clipped(p: Column) -> Column:
    """Values kept away from 0, signs kept."""
    return F.transform(p, lambda x: F.when(F.abs(x) >= MIN_PROBABILITY, x).when(x < 0, -MIN_PROBABILITY).otherwise(MIN_PROBABILITY))


def one_hot(value: Column, nc: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(nc - 1)), lambda i: F.when(i == value, 1.0).otherwise(0.0))


def uniform(nc: int) -> Column:
    return F.array_repeat(F.lit(1.0 / nc), nc)


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    return normalised(F.transform(scores, lambda s: F.exp(s - top)))


def log2_softmax_at(scores: Column, y: Column) -> Column:
    top = F.array_max(scores)
    return (F.get(scores, y) - top) * F.lit(1.4426950408889634) - F.log2(total(F.transform(scores, lambda s: F.exp(s - top))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def xor_constant(p: Column, c: Column, nc: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(nc - 1)), lambda i: F.get(p, i.bitwiseXOR(c)))


def add_constant(p: Column, c: Column, nc: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(nc - 1)), lambda i: F.get(p, F.pmod(i - c, F.lit(nc))))


def negated(p: Column, nc: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(nc - 1)), lambda i: F.get(p, F.pmod(-i, F.lit(nc))))
