"""Exact deduplication by progressive refinement.

Rows are grouped by byte length; those whose length others have too, by the hash of a short prefix; and only those that
still share both with another row have their whole text hashed. What a level leaves is told to the next one by a broadcast
filter of fixed size, which may let a row through that has no equal but never stops one that has: the next, finer grouping
decides. So texts are never shuffled, only lengths and hashes are.

Texts are equal when they are identical after lower-casing A-Z. A null text counts as empty. Of equal texts the row with
the largest doc_id stays (null ids lose against any id); of rows equal in id and text too, one stays. Empty tables give
empty results; columns other than id and text are carried along untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, bitmaps, cut, drop_rows, small, table, with_maybe


def with_survivors(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with whether others have the same keys too (never false if so); rows without keys have no others."""
    counts = rows.filter(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return with_maybe(rows, cut(bitmaps(counts.filter("_rows > 1"), *keys)), name, *keys).withColumn(name, F.col(name) & F.col(keys[-1]).isNotNull())


def refined(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix_chars: int = 64) -> DataFrame:
    """doc_id and text with _sha, the hash of the whole normalised text, for rows that the first two levels leave and null
    for all others, which have no equal."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("_length", F.octet_length(whole))
    rows = with_survivors(rows, ["_length"], "_same_length")
    rows = rows.withColumn("_prefix", F.when(F.col("_same_length"), F.xxhash64(ascii_lower(F.substring(whole, 1, prefix_chars)))))
    rows = with_survivors(rows, ["_length", "_prefix"], "_alive")
    return rows.select("doc_id", "text", F.when(F.col("_alive"), F.unhex(F.sha2(ascii_lower(whole), 256))).alias("_sha"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept; with digest also text_sha256, which has the whole
    text of every document hashed."""
    rows = refined(docs, doc_id, text)
    extra = [F.coalesce("_sha", F.unhex(F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256))).alias("_digest")] if digest else []
    rows = cut(rows.select("doc_id", "_sha", *extra, F.monotonically_increasing_id().alias("_row")))
    best = F.max(F.struct("doc_id", "_row"))
    groups = rows.filter("_sha is not null").groupBy("_sha").agg(best.alias("_best"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    # a table of its own: its join may broadcast, and else Spark can split a key that has very many rows
    out = rows.filter("_sha is not null").join(small(cut(groups)), "_sha", "left")
    columns = {
        "keep_id": F.when(F.col("_n").isNull(), F.col("doc_id")).otherwise(F.col("_best.doc_id")),
        "group_size": F.coalesce("_n", F.lit(1)).cast("long"),
        "kept": F.col("_n").isNull() | (F.col("_best._row") == F.col("_row")),
    }
    more = {"text_sha256": F.lower(F.hex("_digest"))} if digest else {}
    # rows that surely have no equal need no join
    alone = rows.filter("_sha is null").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)} | more)
    names = ["doc_id", *columns, *more]
    return out.withColumns(columns | more).select(names).unionByName(alone.select(names))


def drop_exact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    rows = cut(refined(docs, doc_id, text).select(F.col("doc_id").alias("_id"), "_sha"))
    same = rows.filter("_sha is not null").groupBy("_sha", "_id").agg(F.count(F.lit(1)).alias("_copies"))
    best = same.groupBy("_sha").agg(F.max("_id").alias("_keep"), F.sum("_copies").alias("_n")).filter("_n > 1")
    hashed = rows.filter("_sha is not null").join(small(cut(best)), "_sha")
    lost = hashed.filter(~F.col("_id").eqNullSafe(F.col("_keep"))).select(F.col("_sha").alias("_key"), "_id").distinct()
    twice = same.filter("_copies > 1").join(best, "_sha").filter(F.col("_id").eqNullSafe(F.col("_keep"))).select(F.col("_sha").alias("_key"), "_id")
    whole = F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text), F.lit(""))), 256))
    return drop_rows(docs, whole, doc_id, lost, twice)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of documents."""
    return exact_groups(table(spark, sf_dir, "documents"), digest=True)


OP6_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), h AS (SELECT doc_id, sha256(norm) AS text_sha256 FROM t)
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256)
"""
