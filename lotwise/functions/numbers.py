"""Money, bands and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def banded(c: Column, bounds: list[tuple[float, str]], last: str) -> Column:
    """Name of the first band whose upper bound is at least the value; null stays null."""
    out = F.lit(last)
    for top, name in reversed(bounds):
        out = F.when(c <= top, name).otherwise(out)
    return F.when(c.isNotNull(), out)


def two_figures(c: Column, up: bool = False) -> Column:
    """Rounded down (or up) to two significant figures."""
    step = F.pow(F.lit(10.0), F.floor(F.log10(c)) - 1)
    return F.when(c > 0, (F.ceil(c / step) if up else F.floor(c / step)) * step)


def hammer_of(reported: Column, realised: Column, ratio: float) -> Column:
    """(hammer, basis): as reported, else the realised price over the premium ratio."""
    derived = F.round(realised / ratio, 2)
    return F.struct(F.coalesce(reported, derived).alias("hammer"), F.when(reported.isNotNull(), "reported").when(realised.isNotNull(), "derived").alias("basis"))


def years_between(a: Column, b: Column) -> Column:
    return F.datediff(b, a) / 365.25
