"""Targets of timesteps as they arrive.

The width of a one-hot target is that of the largest class of all timesteps so far, so it may grow with each one. State keeps
the largest class and the number of rows; what a timestep adds comes to it as one row. Targets are kept as classes, and
widened to the width that holds when they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import nhsteps, one_hot
from ..sources import FORMATS
from ..sources.grid import rows_of

WIDTHS = "num_timesteps int, n_rows long, max_nhsteps int"


class Widths(StatefulProcessor):
    """Of rows (timestep, n, most), in the order of their timesteps: how many timesteps and rows there are, and the largest
    class of all."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        kinds = {"num_timesteps": T.IntegerType(), "n_rows": T.LongType(), "max_nhsteps": T.IntegerType()}
        self.state = handle.getValueState("widths", T.StructType([T.StructField(n, t) for n, t in kinds.items()]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        count, total, largest = self.state.get() if self.state.exists() else (0, 0, -1)
        out = []
        for r in pd.concat(list(rows)).sort_values("timestep").itertuples():
            count, total, largest = count + 1, total + int(r.n), max(largest, int(r.most))
            out.append((count, total, largest))
        self.state.update((count, total, largest))
        yield pd.DataFrame(out, columns=["num_timesteps", "n_rows", "max_nhsteps"])

    def close(self) -> None:
        pass


def arriving(spark: SparkSession, folder: str, variable: str = "ncsteps", files: int = 1) -> DataFrame:
    """A stream of the rows (variable, timestep, x, y, value) of the files of a variable of rank 1, so many files at a time,
    older files first."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", f"{variable}_*.{{{','.join(FORMATS)}}}").load(folder)
    return raw.select("path", "content").mapInArrow(rows_of({variable: 1}), "variable string, timestep int, x int, y int, value float")


def class_widths(stream: DataFrame) -> DataFrame:
    """After each timestep of a stream of rows (timestep, x, value): num_timesteps, n_rows, max_nhsteps. A timestep is read by
    one task, which counts it; the state gets a row for each. A timestep arrives whole."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        for batch in batches:
            for r in batch.to_pandas().groupby("timestep")["cls"].agg(["size", "max"]).itertuples():
                held = sums.setdefault(int(r.Index), [0, -1])
                held[0], held[1] = held[0] + int(r.size), max(held[1], int(r.max))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s[0] for s in sums.values()], pa.int64()), pa.array([s[1] for s in sums.values()], pa.int32())], ["timestep", "n", "most"])

    classes = stream.select("timestep", nhsteps(F.col("value")).alias("cls")).mapInArrow(counted, "timestep int, n long, most int")
    return classes.withColumn("all", F.lit(0)).groupBy("all").transformWithStateInPandas(Widths(), WIDTHS, "Append", "None")


def widened(classes: DataFrame, widths: DataFrame) -> DataFrame:
    """The targets of a table of classes (timestep, x, nhsteps), as wide as the table of widths says now."""
    most = widths.agg(F.max("max_nhsteps")).first()[0]
    return classes.withColumn("target", one_hot(F.col("nhsteps"), most))
