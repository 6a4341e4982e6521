"""Targets: classes, their width, and one-hot forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import is_class, nhsteps


def with_nhsteps(df: DataFrame, ncsteps: str, name: str = "nhsteps") -> DataFrame:
    return df.withColumn(name, nhsteps(F.col(ncsteps)))


def max_nhsteps(df: DataFrame, name: str = "nhsteps") -> int | None:
    """The largest class of all rows; one number comes to the driver."""
    return df.agg(F.max(name)).first()[0]


def onehot_long(df: DataFrame, keys: list[str], name: str = "nhsteps") -> DataFrame:
    """keys, cls and target for each class up to the largest one, which a single row holds: no action is needed."""
    most = df.agg(F.max(name).alias("_most"))
    out = df.select(*keys, name).crossJoin(F.broadcast(most))
    return out.select(*keys, name, F.explode(F.sequence(F.lit(0), F.col("_most"))).alias("cls")).select(*keys, "cls", is_class(F.col(name), F.col("cls")).alias("target"))


def onehot_wide(df: DataFrame, keys: list[str], most: int, name: str = "nhsteps") -> DataFrame:
    """keys and a column target_j for each class 0 to most."""
    return df.select(*keys, *(is_class(F.col(name), j).alias(f"target_{j}") for j in range(most + 1)))


def class_histogram(df: DataFrame, name: str = "nhsteps") -> DataFrame:
    """cls and n for each class up to the largest one, with n = 0 where none occurs."""
    counts = df.groupBy(F.col(name).alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    every = counts.agg(F.max("cls").alias("_most")).select(F.explode(F.sequence(F.lit(0), "_most")).alias("cls"))
    return every.join(counts, "cls", "left").select("cls", F.coalesce("n", F.lit(0)).alias("n"))
