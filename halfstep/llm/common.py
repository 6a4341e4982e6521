"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import cut, done, numbered, scratch

__all__ = ["ascii_lower", "bitmaps", "bits_for", "cut", "done", "drop_rows", "lean", "numbered", "occurrences", "ranked", "scratch", "small", "table", "unit", "with_maybe"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word is a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a table that may be broadcast.
BROADCAST_ROWS = 200_000
#: Bits of a broadcast filter, at least (8 MB) and at most (256 MB), and how many there are for each key in between.
BITS, MOST_BITS, KEY_BITS = 1 << 26, 1 << 31, 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task, with memory that Arrow and the C library hold for later given back after each."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        _give_back(0)


@functools.cache
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def _give_back(keep: int) -> None:
    _trim()(keep)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def unit(*cols: Column | str, seed: int) -> Column:
    """A number in (0, 1) that depends on the columns and the seed alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)
    return (bits.cast("double") + 0.5) / float(2**53)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most this many rows, BROADCAST_ROWS unless told otherwise; else as it is, for
    a shuffled join. For tables whose rows are keys, hashes and numbers, of at most about a hundred bytes."""
    rows = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ranked(df: DataFrame, groups: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Adds the 0-based place of each row within its groups, ordered by bucket and then by order, without bringing a
    whole group to one task: places within a bucket are counted in windows over (groups, bucket), and the buckets'
    counts give each bucket's start."""
    df = df.withColumn("_bucket", bucket)
    keys = [*groups, "_bucket"]
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    starts = starts.select(*(F.col(k).alias(f"_of_{k}") for k in keys), "_start")
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return df.join(starts, same).drop(*(f"_of_{k}" for k in keys)).withColumn(name, F.col("_start") + inner - 1).drop("_bucket", "_start")


def bits_for(keys: int) -> int:
    """Bits of a filter of so many keys: a power of two, with which one in KEY_BITS of other rows passes at most, up to
    MOST_BITS."""
    return max(BITS, min(MOST_BITS, 1 << (KEY_BITS * keys - 1).bit_length()))


def bitmaps(df: DataFrame, *keys: Column | str, bits: int | None = None) -> DataFrame:
    """A filter of the keys of df: (_b, _bits), bits by the keys' hash modulo `bits` (BITS unless told otherwise), in an
    eighth as many bytes at most."""
    at = df.select(F.pmod(F.xxhash64(*keys), F.lit(bits or BITS).cast("long")).alias("_at"))
    return at.groupBy(F.bitmap_bucket_number("_at").alias("_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))


def with_maybe(df: DataFrame, marks: DataFrame, name: str, *keys: Column | str, bits: int | None = None) -> DataFrame:
    """df with a boolean: false only where the keys are surely not among those of marks, which bitmaps() gave with as many
    bits. That is told where the rows are; nothing but the marks is sent."""
    hashed = df.withColumn("_marks_at", F.pmod(F.xxhash64(*keys), F.lit(bits or BITS).cast("long")))
    both = hashed.join(F.broadcast(marks.toDF("_marks_of", "_marks_bits")), F.bitmap_bucket_number("_marks_at") == F.col("_marks_of"), "left")
    place = F.bitmap_bit_position("_marks_at")
    byte = F.conv(F.hex(F.substring("_marks_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0
    return both.withColumn(name, F.coalesce(bit, F.lit(False))).drop("_marks_at", "_marks_of", "_marks_bits")


def occurrences(df: DataFrame, keys: list[str], name: str, order: list[Column] | None = None, bucket: Column | None = None) -> DataFrame:
    """df, a table that cut() gave, with the 0-based place of each row among those alike in keys. Only rows that have such
    are shuffled, and those of one key go to many tasks. Which of the rows alike in all columns gets which place is
    open, which makes no difference to the rows as a whole."""
    alike = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*(F.col(k).alias(f"_as_{k}") for k in keys)))
    if alike.isEmpty():
        return df.withColumn(name, F.lit(0).cast("long"))
    near, same = small(alike), [F.col(k).eqNullSafe(F.col(f"_as_{k}")) for k in keys]
    many = cut(df.join(near, same, "left_semi").withColumn("_mine", F.monotonically_increasing_id()))
    bucket = F.pmod(F.xxhash64("_mine"), F.lit(64)).cast("int") if bucket is None else bucket
    many = ranked(many, keys, bucket, [*(order or []), F.col("_mine")], name).drop("_mine")
    return df.join(near, same, "left_anti").withColumn(name, F.lit(0).cast("long")).unionByName(many.withColumn(name, F.col(name).cast("long")))


def drop_rows(docs: DataFrame, key: Column, doc_id: str, lost: DataFrame, twice: DataFrame) -> DataFrame:
    """docs without the rows whose (key, doc_id) is in lost (_key, _id), and with one row only of those in twice. Either
    table is broadcast if it is small; if not, rows whose key is surely in neither pass as they are, and only the others
    are shuffled. Rows alike in key and id are merged before that."""

    def match(other: DataFrame) -> Column:
        return (F.col("_whole") == other["_key"]) & F.col("_own").eqNullSafe(other["_id"])

    lost, twice = cut(lost), cut(twice)
    # a row goes as a struct, so its columns can have any names
    rows = docs.select(F.struct("*").alias("_row"), key.alias("_whole"), F.col(doc_id).alias("_own"))
    away, sure = small(lost), None
    if away is lost:
        keys = lost.select("_key").union(twice.select("_key"))
        bits = bits_for(keys.count())
        rows = with_maybe(rows, cut(bitmaps(keys, "_key", bits=bits)), "_maybe", "_whole", bits=bits)
        sure, rows = rows.filter("not _maybe").drop("_maybe"), rows.filter("_maybe").drop("_maybe")
    left = rows.join(away, match(lost), "left_anti")
    if not twice.isEmpty():
        near = small(twice)
        left = left.join(near, match(twice), "left_anti").unionByName(left.join(near, match(twice), "left_semi").dropDuplicates(["_whole", "_own"]))
    return (left if sure is None else sure.unionByName(left)).select("_row.*")
