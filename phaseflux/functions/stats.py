"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 0.975 quantile of the normal distribution.
Z = 1.959963984540054


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0.0 for a zero or null bottom."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """95 % score interval of k of n; null unless n > 0."""
    k, n = k.cast("double"), F.when(n > 0, n.cast("double"))
    p, zz = k / n, Z * Z
    centre = (p + zz / (2 * n)) / (1 + zz / n)
    half = Z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    some = n.isNotNull()
    return F.when(some, F.greatest(F.lit(0.0), centre - half)), F.when(some, F.least(F.lit(1.0), centre + half))


def years(start: Column, end: Column) -> Column:
    """Years between two dates if the end is later, else null."""
    days = F.datediff(end, start)
    return F.when(days > 0, days / F.lit(365.25))
