"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(c: Column) -> Column:
    """At length 1; a zero vector stays."""
    n = F.sqrt(dot(c, c))
    return F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def stored_scale(c: Column) -> Column:
    """A cosine on the scale from 0 to 1 that thresholds of vector stores use."""
    return (1 + c) / 2


def title_similarity(c: Column, low: float = 0.72, high: float = 0.96) -> Column:
    """A cosine stretched so that ``low`` is 0 and ``high`` 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c - low) / (high - low)))
