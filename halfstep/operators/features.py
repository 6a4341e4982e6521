"""Features: components of 2D variables, their names, and the stacked matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature_names(features_1d: list[str], components: dict[str, int]) -> list[str]:
    """1D variables in order, then the components of each 2D variable."""
    return [*features_1d, *(f"{name}_{j}" for name, n in components.items() for j in range(n))]


def slice_unpack(df: DataFrame, keys: list[str], array: str) -> DataFrame:
    """A row for each component of an array column: keys, component, value."""
    return df.select(*keys, F.posexplode(array).alias("component", "value"))


def slices_wide(df: DataFrame, keys: list[str], array: str, n: int, prefix: str, dtype: str = "float") -> DataFrame:
    """A column for each of n components; rows with another number of them are errors."""
    size = F.when(F.size(array) == n, F.col(array)).otherwise(F.raise_error(F.concat(F.lit(f"'{array}' must have {n} components, not "), F.size(array).cast("string"))))
    return columns_of(df.select(*keys, size.alias("_a")), keys, "_a", [f"{prefix}_{j}" for j in range(n)], dtype)


def columns_of(df: DataFrame, keys: list[str], array: str, names: list[str], dtype: str) -> DataFrame:
    """keys, and the elements of an array as columns, through 32-bit floats. One call to the JVM plans all of them."""
    quoted = ["`" + n.replace("`", "``") + "`" for n in [*keys, *names]]
    return df.selectExpr(*quoted[: len(keys)], *(f"CAST(CAST({array}[{k}] AS FLOAT) AS {dtype}) AS {n}" for k, n in enumerate(quoted[len(keys) :])))


def _positions(features_1d: list[str], components: dict[str, int]) -> Column:
    """The place of a row's feature among all, from its variable and y; null if it is none of them."""
    position, at = F.lit(None).cast("int"), 0
    for v in features_1d:
        position, at = F.when((F.col("variable") == v) & F.col("y").isNull(), F.lit(at)).otherwise(position), at + 1
    for v, n in components.items():
        position, at = F.when((F.col("variable") == v) & (F.col("y") < n), F.col("y") + at).otherwise(position), at + n
    return position


def _checked(found: Column, names: list[str], where: Column, value: Column) -> Column:
    """value, if the places found (sorted) are those of all features, each once."""
    want = F.sequence(F.lit(0), F.lit(len(names) - 1))
    lacks = F.get(F.array_except(want, found), F.lit(0))
    twice = F.get(F.filter(want, lambda k: F.size(F.filter(found, lambda p: p == k)) > 1), F.lit(0))
    name = _named(names, F.coalesce(lacks, twice))
    return (
        F.when(found == want, value)
        .when(F.exists(found, F.isnull), F.raise_error(F.concat(F.lit("a 2D feature has more components than at the first timestep"), where)))
        .otherwise(F.raise_error(F.concat(F.lit("feature '"), name, F.lit("' has not exactly one value"), where)))
    )


def _named(names: list[str], k: Column) -> Column:
    """The kth name; names have no line breaks, as files are named after them."""
    return F.get(F.split(F.lit("\n".join(names)), "\n"), k)


def _at(x: Column) -> Column:
    return F.concat(F.lit(" at timestep "), F.col("timestep").cast("string"), F.lit(", x "), x.cast("string"))


def stack_features(grid: DataFrame, features_1d: list[str], components: dict[str, int], dtype: str = "float") -> DataFrame:
    """(timestep, x, one column for each feature) from rows (variable, timestep, x, y, value), in one shuffle. A grid
    point that lacks a feature, or has one twice, is an error."""
    names = feature_names(features_1d, components)
    # as many values as there are features meet at a grid point
    points = grid.groupBy("timestep", "x").agg(F.array_sort(F.collect_list(F.struct(_positions(features_1d, components).alias("p"), "value"))).alias("_f"))
    wide = points.select("timestep", "x", _checked(F.col("_f.p"), names, _at(F.col("x")), F.col("_f.value")).alias("_v"))
    return columns_of(wide, ["timestep", "x"], "_v", names, dtype)


def stack_ranges(ranges: DataFrame, features_1d: list[str], components: dict[str, int], dtype: str = "float") -> DataFrame:
    """The same from rows (variable, timestep, y, start, values): the features' arrays of one range of grid points meet,
    so what is shuffled has a row for thousands of values. Features of other lengths, and nulls, are errors too."""
    names = feature_names(features_1d, components)
    parts = ranges.groupBy("timestep", "start").agg(F.array_sort(F.collect_list(F.struct(_positions(features_1d, components).alias("p"), "values"))).alias("_f"))
    arrays = _checked(F.col("_f.p"), names, _at(F.col("start")), F.col("_f.values"))
    sizes = F.transform("_v", F.size)
    short = F.array_position(F.transform(sizes, lambda n: n < F.array_max(sizes)), F.lit(True)).cast("int") - 1
    where = F.get(sizes, short) + F.col("start")
    even = F.when(short < 0, F.col("_v")).otherwise(F.raise_error(F.concat(F.lit("feature '"), _named(names, short), F.lit("' has not exactly one value"), _at(where))))
    gaps = F.transform("_v", lambda values: F.array_position(F.transform(values, F.isnull), F.lit(True)).cast("int") - 1)
    gap = F.array_position(F.transform(gaps, lambda k: k >= 0), F.lit(True)).cast("int") - 1
    full = F.when(gap < 0, F.col("_v")).otherwise(F.raise_error(F.concat(F.lit("feature '"), _named(names, gap), F.lit("' is null"), _at(F.get(gaps, gap) + F.col("start")))))
    parts = parts.select("timestep", "start", arrays.alias("_v")).withColumn("_v", even).withColumn("_v", full)
    rows = parts.selectExpr("timestep", "start", f"posexplode(arrays_zip({', '.join(f'_v[{k}]' for k in range(len(names)))})) AS (_i, _row)")
    quoted = ("`" + n.replace("`", "``") + "`" for n in names)
    return rows.selectExpr("timestep", "CAST(start + _i AS INT) AS x", *(f"CAST(CAST(_row.`{k}` AS FLOAT) AS {dtype}) AS {n}" for k, n in enumerate(quoted)))
