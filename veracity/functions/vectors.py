"""Vector math as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_l2(a: Column, b: Column) -> Column:
    """sum of squared element differences, in double (floats cast first)."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)),
        F.lit(0.0).cast("double"), lambda acc, x: acc + x)
