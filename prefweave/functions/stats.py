"""Aggregates with a defined value where the built-in ones fail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def corr(x: Column, y: Column) -> Column:
    """Pearson's correlation; null if either column is constant (the built-in one divides by zero there)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
