"""Gridded variables as DataFrames.

A variable has a file for each timestep, `<folder>/<variable>_<timestep>.<extension>`. Files are read by Spark's text source
(CDL, by blocks: see lines) or binary source (whole), so they may be in any store Spark reads, and are parsed where they are
read. Rows are (variable, timestep, x, y, value): x is the place in the grid, y the component (null for a variable of rank
1). Values are 32-bit floats, null where the file has the fill value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import cdl, classic, lines, nc4
from .names import FORMATS, SCHEMA, file_name
from .datasource import absolute, shape_of, write_text
from .ranges import SCHEMES, found, scheme

#: Grid points whose values go in one array when variables are brought together, and in a line of text.
RANGE, LINE = 8_192, 1_024


def parse(content: bytes) -> dict[str, np.ma.MaskedArray]:
    if content[:3] == b"CDF":
        return classic.parse(content)
    return nc4.parse(content) if content[:4] == b"\x89HDF" else cdl.parse(content)


def _named(path: str) -> tuple[str, int]:
    variable, _, timestep = path.rpartition("/")[2].rpartition(".")[0].rpartition("_")
    return variable, int(timestep)


def values_of(content: bytes, variable: str) -> np.ma.MaskedArray:
    return found(parse(content), variable)


def _values(batches: Iterator[pa.RecordBatch], ranks: dict[str, int]) -> Iterator[tuple[str, int, np.ma.MaskedArray]]:
    """Variable, timestep and values of each file of rows (path, content)."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            variable, timestep = _named(path)
            v = values_of(content.as_py(), variable)
            if v.ndim != ranks[variable]:
                raise ValueError(f"'{variable}' was declared with {ranks[variable]} dimension(s) but has {v.ndim} at timestep {timestep}")
            yield variable, timestep, v


def rows_of(ranks: dict[str, int]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for variable, timestep, v in _values(batches, ranks):
            n = v.shape[-1]
            flat = np.ma.getdata(v).astype(np.float32).ravel()
            y = pa.array(np.repeat(np.arange(v.shape[0], dtype=np.int32), n)) if v.ndim == 2 else pa.nulls(n, pa.int32())
            x = np.tile(np.arange(n, dtype=np.int32), flat.size // n if n else 0)
            columns = [pa.array([variable] * flat.size, pa.string()), pa.array(np.full(flat.size, timestep, np.int32)), pa.array(x), y, pa.array(flat, mask=np.ma.getmaskarray(v).ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["variable", "timestep", "x", "y", "value"])

    return rows


def _ranges(ranks: dict[str, int]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for variable, timestep, v in _values(batches, ranks):
            for y, line in enumerate(np.ma.atleast_2d(v)):
                part = [line[k : k + RANGE] for k in range(0, max(1, len(line)), RANGE)]
                values = pa.array([pa.array(np.ma.getdata(p).astype(np.float32), mask=np.ma.getmaskarray(p)) for p in part], pa.list_(pa.float32()))
                columns = [pa.array([variable] * len(part), pa.string()), pa.array([timestep] * len(part), pa.int32()), pa.array([y if v.ndim == 2 else None] * len(part), pa.int32()), pa.array(np.arange(len(part)) * RANGE, pa.int64()), values]
                yield pa.RecordBatch.from_arrays(columns, ["variable", "timestep", "y", "start", "values"])

    return rows


def paths(spark: SparkSession, folder: str, variables: list[str], timesteps: range) -> list[str]:
    """The files of these variables; the extension is that of the first variable's first file."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    exists = lambda p: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p))
    found = next((e for e in FORMATS if exists(file_name(folder, variables[0], timesteps[0], e))), FORMATS[0])
    return [file_name(folder, v, t, found) for v in variables for t in timesteps]


def _files(spark: SparkSession, folder: str, ranks: dict[str, int], num_timesteps: int) -> list[str]:
    if num_timesteps < 1:
        raise ValueError("num_timesteps must be at least 1")
    if any(r not in (1, 2) for r in ranks.values()):
        raise AssertionError("Only feature data with 1 or 2 dimensions are supported.")
    return paths(spark, folder, list(ranks), range(1, num_timesteps + 1))


def _whole(spark: SparkSession, files: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(files).select("path", "content")


def read_grid(spark: SparkSession, folder: str, ranks: dict[str, int], num_timesteps: int) -> DataFrame:
    """Rows of the variables (name: rank, 1 or 2) for timesteps 1 to num_timesteps. CDL files are parsed now, by blocks; those
    that can't be, and other files, by a task whole."""
    files = _files(spark, folder, ranks, num_timesteps)
    if not files[0].endswith(".cdl"):
        return _whole(spark, files).mapInArrow(rows_of(dict(ranks)), SCHEMA)
    rows, plain = lines.read(spark, files, ranks)
    odd = [f for f in files if _named(f) not in plain]
    return rows.unionAll(_whole(spark, odd).mapInArrow(rows_of(dict(ranks)), SCHEMA)) if odd else rows


def read_ranges(spark: SparkSession, folder: str, ranks: dict[str, int], num_timesteps: int) -> DataFrame:
    """The same values as a row for each variable, component and RANGE of grid points: (variable, timestep, y, start,
    values)."""
    return _whole(spark, _files(spark, folder, ranks, num_timesteps)).mapInArrow(_ranges(dict(ranks)), "variable string, timestep int, y int, start long, values array<float>")


def variable_shape(spark: SparkSession, folder: str, variable: str) -> tuple[int, ...]:
    """The shape of a variable at its first timestep, from the file's header; in stores that only Spark reads, from the whole
    file, by a task."""
    if scheme(folder) in SCHEMES:
        return shape_of(absolute(folder), variable)

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([list(values_of(c.as_py(), variable).shape) for c in batch.column(0)], pa.list_(pa.int64()))], ["shape"])

    (path,) = paths(spark, folder, [variable], range(1, 2))
    return tuple(spark.read.format("binaryFile").load(path).select("content").mapInArrow(shape, "shape array<long>").first()["shape"])


def write_cdl(grid: DataFrame, folder: str) -> None:
    """Writes rows (variable, timestep, x, y, value), as read_grid() gives them, as CDL files, one for each variable and
    timestep, null as `_`: at places in them where the folder is mounted, by many tasks; elsewhere a file by one task, which
    sorts lines of LINE values."""
    spark = grid.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() == "file":
        write_text(grid, folder)
    else:
        _write_lines(grid, folder, fs)


def _write_lines(grid: DataFrame, folder: str, fs) -> None:
    """As write_cdl(), by Spark's text source alone."""
    hadoop = grid.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
    two = F.col("_ny").isNotNull()
    sizes = grid.groupBy("variable", "timestep").agg((F.max("x") + 1).alias("_nx"), (F.max("y") + 1).alias("_ny"))
    head = F.concat(F.lit("netcdf "), "variable", F.lit("_"), F.col("timestep").cast("string"), F.lit(" {\ndimensions:\n\tx = "), F.col("_nx").cast("string"), F.lit(" ;\n"), F.when(two, F.concat(F.lit("\ty = "), F.col("_ny").cast("string"), F.lit(" ;\n"))).otherwise(F.lit("")), F.lit("variables:\n\tfloat "), "variable", F.when(two, F.lit("(y, x)")).otherwise(F.lit("(x)")), F.lit(" ;\ndata:\n\n "), "variable", F.lit(" ="))
    columns = ["variable", "timestep", "_y", "_x", "line"]
    top = sizes.withColumns({"_y": F.lit(-1), "_x": F.lit(0), "line": head})
    end = sizes.withColumns({"_y": F.lit(2**31 - 1), "_x": F.lit(0), "line": F.lit(" ;\n}")})
    cell = F.struct(F.col("x"), F.coalesce(F.col("value").cast("float").cast("string"), F.lit("_")).alias("value"))
    rows = grid.groupBy("variable", "timestep", F.coalesce("y", F.lit(0)).alias("_y"), F.floor(F.col("x") / LINE).cast("int").alias("_x")).agg(F.array_sort(F.collect_list(cell)).alias("_v"))
    first = (F.col("_x") == 0) & (F.col("_y") == 0)
    rows = rows.withColumn("line", F.concat(F.when(first, F.lit("  ")).otherwise(F.lit(", ")), F.array_join(F.col("_v.value"), ", ")))
    lines = top.select(columns).union(rows.select(columns)).union(end.select(columns)).repartition("variable", "timestep").sortWithinPartitions("variable", "timestep", "_y", "_x")
    out = f"{folder.rstrip('/')}/_lines"
    lines.select("variable", "timestep", "line").write.partitionBy("variable", "timestep").option("maxRecordsPerFile", 0).text(out)
    for f in fs.globStatus(hadoop.Path(f"{out}/variable=*/timestep=*/part-*")):
        name, timestep = (p.partition("=")[2] for p in f.getPath().toString().split("/")[-3:-1])
        fs.rename(f.getPath(), hadoop.Path(file_name(folder, name, int(timestep), "cdl")))
    fs.delete(hadoop.Path(out), True)


def with_row_numbers(df: DataFrame) -> DataFrame:
    """df (timestep, x, ...) with row, the 0-based place of a grid point over all timesteps in order. Only the sizes of
    the timesteps are summed; rows aren't sorted."""
    sizes = df.groupBy("timestep").agg((F.max("x") + 1).cast("long").alias("_size"))
    before = Window.orderBy("timestep").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("timestep", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return df.join(F.broadcast(starts), "timestep").withColumn("row", F.col("_start") + F.col("x")).drop("_start")
