"""Streams of grid points.

The width of a one-hot target depends on all rows, which a stream never has; so the largest class is fixed beforehand and
larger ones are errors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nhsteps, one_hot
from ..operators.network import FCNN


def halving_stream(stream: DataFrame, ncsteps: str, most: int) -> DataFrame:
    """stream with nhsteps and target over classes 0 to most; it needs no state."""
    out = stream.withColumn("_n", nhsteps(F.col(ncsteps)))
    fits = F.when(F.col("_n") <= most, F.col("_n")).otherwise(F.raise_error(F.lit(f"a class is larger than {most}"))).cast("int")
    return out.withColumn("nhsteps", fits).drop("_n").withColumn("target", one_hot(F.col("nhsteps"), most))


def score_stream(stream: DataFrame, model: FCNN, column: str = "features") -> DataFrame:
    """stream with the probabilities of each row, by batches, without state."""
    return model(stream, column)


def class_counts(stream: DataFrame, time: str, width: str, late: str, name: str = "nhsteps") -> DataFrame:
    """How often each class occurs in windows of this width; rows may come so late."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), name).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), name, "n")
