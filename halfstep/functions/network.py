"""Activations as column expressions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relu(x: Column) -> Column:
    """max(0, x); null stays null (greatest() alone would make it 0)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def softmax(z: Column) -> Column:
    """exp(z - max) / sum, over an array."""
    top = F.array_max(z)
    e = F.transform(z, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
