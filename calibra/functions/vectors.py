"""Probability vectors of any length as array columns; all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-6


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x)


def clipped(p: Column, least: float = FLOOR) -> Column:
    return F.transform(p, lambda x: F.greatest(x, F.lit(least)))


def normalized(p: Column, least: float = FLOOR) -> Column:
    """Clipped below and divided by the sum."""
    return F.transform(F.array(clipped(p, least)), lambda q: F.transform(q, lambda x: x / total(q)))[0]


def rescaled(p: Column) -> Column:
    """Divided by the sum; uniform if there is no mass."""
    return F.when(total(p) > 0, F.transform(p, lambda x: x / total(p))).otherwise(F.transform(p, lambda x: F.lit(1.0) / F.size(p)))


def argmax(p: Column) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def powered(p: Column, exponent: Column | float, least: float = 1e-12) -> Column:
    """Each probability to a power, renormalized."""
    return rescaled(F.transform(p, lambda x: F.pow(F.greatest(x, F.lit(least)), exponent)))


def power_or_uniform(p: Column, exponent: Column | float) -> Column:
    """Zeros stay zero; a vector without mass becomes uniform."""
    return rescaled(F.transform(p, lambda x: F.when(x > 0, F.pow(x, exponent)).otherwise(F.lit(0.0))))


def tempered(p: Column, temperature: Column | float) -> Column:
    """Softmax of clipped log-probabilities over a temperature."""
    t = temperature if isinstance(temperature, Column) else F.lit(temperature)
    return F.transform(F.array(F.transform(p, lambda x: F.exp(F.ln(F.greatest(x, F.lit(FLOOR))) / t))), lambda q: F.transform(q, lambda x: x / total(q)))[0]


def rounded(p: Column, digits: int = 2) -> Column:
    """On a grid of decimals (half to even, of the scaled double), renormalized; uniform if nothing is left."""
    return rescaled(F.transform(p, lambda x: F.rint(x * 10**digits) / 10**digits))


def at(p: Column, i: Column) -> Column:
    return F.get(p, i)


def squared_error(p: Column, y: Column) -> Column:
    """Sum over options of the squared distance to the one-hot label."""
    return F.aggregate(F.transform(p, lambda x, i: F.pow(x - F.when(i == y, 1.0).otherwise(0.0), 2.0)), F.lit(0.0), lambda a, x: a + x)


def squared_distance(p: Column, q: Column) -> Column:
    return F.aggregate(F.zip_with(p, q, lambda x, z: F.pow(x - z, 2.0)), F.lit(0.0), lambda a, x: a + x)


def dot(p: Column, q: Column) -> Column:
    return F.aggregate(F.zip_with(p, q, lambda x, z: x * z), F.lit(0.0), lambda a, x: a + x)


def unit(p: Column) -> Column:
    """At length one; null without a length."""
    return F.transform(p, lambda x: F.try_divide(x, F.sqrt(dot(p, p))))


def cosine(p: Column, q: Column) -> Column:
    return F.try_divide(dot(p, q), F.sqrt(dot(p, p)) * F.sqrt(dot(q, q)))
