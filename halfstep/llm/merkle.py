"""Merkle fixity audit of WARC replicas.

Each page is a WARC record, kept in order of its key's hash. Where a record lies in the tree follows from that hash alone:
its first bits name the file, more of them the leaf (about LEAF_RECORDS records), and each FANOUT neighbours have a node
above, up to one root. A node's SHA-256 covers, in order, the offset ranges of its children within it and their hashes; a
record's is that of its bytes. So a lost, added or changed record changes the nodes on its own path and no others.

Replicas are laid out each on its own. They are compared at their roots; only children of nodes that differ are compared
below, and of the tables of records and of the levels below the files' own nodes only the files with such nodes are read. Within a leaf that differs, records are compared by
key, so one of them makes one difference.

A record's key is its page_id, url and, among records alike in these, its place by digest (a change among those may show
as two). Null ids and urls are values like others; a null body counts as empty. Empty tables have no difference. Columns
other than id, url and body may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, occurrences, small, table

#: Records of a leaf, bits from one level to the next, and bits of the files' number at most: half of the leaves' bits, so a
#: file has as many leaves as there are files, until there are the most files.
LEAF_RECORDS, STEP, FILE_BITS = 16, 4, 12
DATE = "1970-01-01T00:00:00Z"
KEY = ["page_id", "url", "nth"]


def warc_record(page_id: str = "page_id", url: str = "url", body: str = "html") -> Column:
    """The record of a page as it stands in a WARC file."""
    html, uri = F.coalesce(F.col(body), F.lit("")), F.coalesce(F.col(url), F.lit(""))
    name = F.md5(F.concat_ws("|", F.coalesce(F.col(page_id).cast("string"), F.lit("")), uri))
    uuid = F.concat_ws("-", *(F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    head = ["WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:", uuid, f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: ", uri, "\r\nContent-Type: text/html\r\nContent-Length: ", F.octet_length(html).cast("string"), "\r\n\r\n"]
    return F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in head), html, F.lit("\r\n\r\n"))


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """page_id, url, length and digest of the record of each page."""
    record = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), warc_record(page_id, url, body).alias("_record"))
    return record.select("page_id", "url", F.octet_length("_record").cast("long").alias("length"), F.unhex(F.sha2("_record", 256)).alias("digest"))


def top(k: Column | str, bits: int, of: int = 64) -> Column:
    """The first bits of numbers of so many bits."""
    return F.lit(0).cast("long") if bits == 0 else F.shiftrightunsigned(k, of - bits) if bits < of else F.col(k)


def keyed(rows: DataFrame) -> DataFrame:
    """Records with nth and k, the hash of their key; rows that have them already stay as they are."""
    if "k" in rows.columns:
        return rows
    first_byte = F.conv(F.hex(F.substring("digest", 1, 1)), 16, 10).cast("int")
    return occurrences(cut(rows), ["page_id", "url"], "nth", [F.col("digest")], first_byte).withColumn("k", F.xxhash64(*KEY))


def hashed(children: Column) -> Column:
    """Of structs with length and hash, in order: their offset ranges and hashes, as (length, hash)."""
    start = F.struct(F.lit(0).cast("long").alias("length"), F.lit("").alias("said"))
    said = F.aggregate(children, start, lambda got, x: F.struct((got["length"] + x["length"]).alias("length"), F.concat(got["said"], F.format_string("%d-%d %s;", got["length"], got["length"] + x["length"], F.hex(x["hash"]))).alias("said")))
    return F.transform(F.array(said), lambda s: F.struct(s["length"].alias("length"), F.unhex(F.sha2(s["said"], 256)).alias("hash")))[0]


class Tree:
    """A replica's records, in files by the hash of their key, and the nodes above them: levels[0] are the leaves, the
    last level is the root."""

    def __init__(self, rows: DataFrame, bits: int):
        self.bits, self.file_bits = bits, file_bits_for(bits)
        slim = rows.select(*KEY, "k", "length", F.col("digest").alias("hash"), top("k", bits).alias("node"), top("k", self.file_bits).alias("file"))
        self.records = cut(slim, by="file")
        leaf = F.array_sort(F.collect_list(F.struct("k", *KEY, "length", "hash")))  # about LEAF_RECORDS, as keys differ
        self.levels = [self.kept(self.records.groupBy("node").agg(hashed(leaf).alias("_n")).select("node", "_n.*"), bits)]
        while bits:
            bits -= STEP
            level = self.levels[-1].withColumn("_up", F.shiftrightunsigned("node", STEP))
            nodes = F.array_sort(F.collect_list(F.struct("node", "length", "hash")))
            self.levels.append(self.kept(level.groupBy("_up").agg(hashed(nodes).alias("_n")).select(F.col("_up").alias("node"), "_n.*"), bits))

    def kept(self, level: DataFrame, bits: int) -> DataFrame:
        """A level of nodes of so many bits, as a table in folders by file where a file has several of them."""
        return cut(level.withColumn("file", self.file_of(bits)), by="file") if bits > self.file_bits > 0 else cut(level)

    def file_of(self, bits: int) -> Column:
        """The file of a node of at least as many bits as files' names have."""
        return top("node", self.file_bits, bits) if bits else F.lit(0).cast("long")

    def places(self, files: list[int]) -> DataFrame:
        """Offsets of the records of these files."""
        of = self.records.filter(F.col("file").isin(files))
        before = Window.partitionBy("file").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        within = Window.partitionBy("node").orderBy("k", *KEY).rowsBetween(Window.unboundedPreceding, -1)
        starts = self.levels[0].withColumn("file", self.file_of(self.bits)).filter(F.col("file").isin(files))
        starts = starts.select("node", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("_before"))
        return of.join(starts, "node").withColumn("start", F.col("_before") + F.coalesce(F.sum("length").over(within), F.lit(0))).drop("_before")


def bits_for(count: int) -> int:
    bits = 0
    while count > LEAF_RECORDS << bits:
        bits += STEP
    return bits


def file_bits_for(bits: int) -> int:
    return min(FILE_BITS, bits // 2)


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """The records in which two replicas differ, from rows (page_id, url, length, digest) of each: page_id, url, nth, file,
    start (offset in the first replica's file, null where it lacks the record), hash_a, hash_b (null where the replica
    lacks it)."""
    bits = bits_for(max(a.count(), b.count()))
    trees = [Tree(keyed(x), bits) for x in (a, b)]
    suspects, depth = None, 0
    for x, y in reversed(list(zip(*(t.levels for t in trees), strict=True))):
        if "file" in x.columns and depth - STEP >= trees[0].file_bits:  # a node above that differs tells one file
            files = [r["file"] for r in suspects.select(trees[0].file_of(depth - STEP).alias("file")).distinct().collect()]  # two to the power FILE_BITS at most
            x, y = (z.filter(F.col("file").isin(files)) for z in (x, y))
        if suspects is not None:
            above = small(suspects.withColumnRenamed("node", "_up"))
            x, y = (z.withColumn("_up", F.shiftrightunsigned("node", STEP)).join(above, "_up", "left_semi") for z in (x, y))
        both = x.select("node", F.col("hash").alias("_a")).join(y.select("node", F.col("hash").alias("_b")), "node", "full")
        suspects = cut(both.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("node"))
        if suspects.isEmpty():
            break
        depth += STEP
    files = [r["file"] for r in suspects.select(trees[0].file_of(bits).alias("file")).distinct().collect()]  # two to the power FILE_BITS at most
    mine = trees[0].places(files).join(small(suspects), "node", "left_semi").select("node", *KEY, "file", "start", F.col("hash").alias("hash_a"))
    other = trees[1].records.filter(F.col("file").isin(files)).join(small(suspects), "node", "left_semi").select(*(F.col(c).alias(f"_{c}") for c in ("node", *KEY, "file")), F.col("hash").alias("hash_b"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("node", *KEY)]
    found = mine.join(other, same, "full").filter(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
    ours = F.col("hash_a").isNotNull()
    return found.select(*(F.when(ours, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in (*KEY, "file")), "start", "hash_a", "hash_b")


def op5_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the pages as WARC records against a replica, laid out on its own, in which about one record in 256 has
    another first byte and one in 256 is lost (those whose id's MD5 begins with 00 and 01). Returns page_id, length,
    record_sha256, replica_sha256 (null if lost) and corrupt of every page."""
    pages = table(spark, sf_dir, "pages")
    mark = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, 2)
    sound = cut(keyed(records(pages)))
    record = F.concat(F.when(mark == "00", F.lit("w")).otherwise(F.lit("W")), F.substring(warc_record(), 2, 2**31 - 1))
    replica = pages.filter(mark != "01").select("page_id", "url", record.alias("_record"))
    replica = cut(replica.select("page_id", "url", F.octet_length("_record").cast("long").alias("length"), F.unhex(F.sha2("_record", 256)).alias("digest")))
    broken = audit(sound, replica).filter("hash_a is not null").select(*(F.col(c).alias(f"_{c}") for c in KEY), "hash_b", F.lit(True).alias("_broken"))
    out = sound.join(small(cut(broken)), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY], "left")
    corrupt = F.coalesce("_broken", F.lit(False))
    return out.select("page_id", "length", F.lower(F.hex("digest")).alias("record_sha256"), F.lower(F.hex(F.when(corrupt, F.col("hash_b")).otherwise(F.col("digest")))).alias("replica_sha256"), corrupt.alias("corrupt"))


OP5_SQL = f"""
WITH t AS (
  SELECT page_id, coalesce(url, '') AS uri, coalesce(html, '') AS body,
         md5(coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '')) AS m,
         substr(md5(coalesce(CAST(page_id AS VARCHAR), '')), 1, 2) AS mark
  FROM pages
), r AS (
  SELECT page_id, mark,
         'ARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:'
         || substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12)
         || '>' || chr(13) || chr(10) || 'WARC-Date: {DATE}' || chr(13) || chr(10) || 'WARC-Target-URI: ' || uri || chr(13) || chr(10)
         || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(body)) || chr(13) || chr(10)
         || chr(13) || chr(10) || body || chr(13) || chr(10) || chr(13) || chr(10) AS rest
  FROM t
)
SELECT page_id, CAST(octet_length(encode(rest)) + 1 AS BIGINT) AS length, sha256('W' || rest) AS record_sha256,
       CASE WHEN mark <> '01' THEN sha256(CASE WHEN mark = '00' THEN 'w' ELSE 'W' END || rest) END AS replica_sha256,
       mark IN ('00', '01') AS corrupt
FROM r
"""
