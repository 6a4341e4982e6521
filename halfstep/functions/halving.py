"""Step counts to halving classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nhsteps(ncsteps: Column) -> Column:
    """How often a step was halved, from how many steps it became: log2 in floating point, rounded half to even. Null,
    NaN and counts that would round below class 0 are errors."""
    value = ncsteps.cast("float")
    steps = F.rint(F.log2(value))
    bad = value.isNull() | F.isnan(value) | (value <= 0) | (steps < 0)
    message = F.concat(F.lit("ncsteps must be positive and round to a class of at least 0, not "), F.coalesce(ncsteps.cast("string"), F.lit("null")))
    return F.when(bad, F.raise_error(message)).otherwise(steps.cast("int")).cast("int")


def one_hot(cls: Column, most: int) -> Column:
    """An array over classes 0 to most, with classes that don't occur too."""
    return F.transform(F.sequence(F.lit(0), F.lit(most)), lambda j: (j == cls).cast("int"))


def is_class(cls: Column, j: int) -> Column:
    return (cls == j).cast("int")
