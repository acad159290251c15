"""Columns that hold a value for others."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), where value is worked out once and not again for each element of an inner lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
