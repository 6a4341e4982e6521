"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_sent: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Makes this package's modules importable in Python workers, also where it isn't installed: by the path on this machine,
    and elsewhere by an archive that Spark sends to executors once an application."""
    sc, here = spark.sparkContext, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if here not in path:
        sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [here, *path]))
    if not re.fullmatch(r"local(\[[\d*, ]+\])?", sc.master) and sc.applicationId not in _sent:
        file = os.path.join(tempfile.mkdtemp(prefix="halfstep-"), "halfstep-modules.zip")
        with zipfile.ZipFile(file, "w") as z:
            for folder, _, names in os.walk(os.path.join(here, "halfstep")):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, here))
            if os.path.exists(os.path.join(here, "corpus_pipeline.py")):
                z.write(os.path.join(here, "corpus_pipeline.py"), "corpus_pipeline.py")
        sc.addPyFile(file)
        _sent[sc.applicationId] = file


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, one of our own, but on this machine's
    cores only: elsewhere executors wouldn't see the driver's folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get().rstrip("/")
    if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="halfstep-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder; what is put there goes when the application ends."""
    path = f"{shared_folder(spark)}/halfstep-{uuid.uuid4().hex}"
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


_made: list[list[DataFrame]] = []


def cut(df: DataFrame, by: str | None = None, compression: str | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder, in a folder for each value of `by` if that is given, and reads it back:
    later jobs neither recompute it nor depend on the executors that made it. The files go with done(), at the end of
    scratch(), or when the application ends."""
    path = new_path(df.sparkSession)
    (df.repartition(F.col(by)).write.partitionBy(by) if by else df.write).parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    for made in _made:
        made.append(out)
    return out


def done(*tables: DataFrame) -> None:
    """Deletes the files of tables that cut() gave and that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._cut_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives a cut() whose tables stay; all others that are made meanwhile are deleted at the end."""
    made: list[DataFrame] = []
    stay: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        stay.append(cut(df))
        return stay[-1]

    _made.append(made)
    try:
        yield keep
    finally:
        _made.remove(made)
        done(*(t for t in made if all(t is not s for s in stay)))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the 0-based place of each row in this order: rows are dealt by ranges, sorted there, and only the numbers
    of rows of the ranges are summed."""
    place = F.monotonically_increasing_id()
    dealt = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.shiftrightunsigned(place, 33), "_in_range": place.bitwiseAND(F.lit((1 << 33) - 1))}))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_in_range")).drop("_range", "_in_range", "_start")
