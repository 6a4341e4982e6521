"""The prefix trie of conversations, screened by a count-min sketch.

A conversation's turns in order (by number, null first; turns of one number by the digest of role and text) are its path from
the root; a node is a distinct sequence of first turns. A prefix has a digest of 128 bits: the exclusive or of hashes of its
turns with their places, so digests of all prefixes are running sums, taken in blocks of BLOCK turns, and a prefix's parent
is the digest without the last turn's hash.

How often each digest occurs is estimated by a count-min sketch: two rows of counters, one for each half of the digest, built
where the digests are and added up. An estimate is never too low, so an estimate of one proves that no other conversation
has the prefix. Such nodes (nearly all, in a corpus of unlike conversations) are told where they are, with all that is to be
known of them; only prefixes of larger estimates are shuffled and grouped exactly. The sketch has CELLS_A_PREFIX cells for
each prefix; where that is more than MOST_CELLS, conversations are dealt into slices by their first turn, which are screened
one after another, each by a sketch of its own. Full sketches only let more prefixes through to the exact grouping.

The smallest member of a prefix owns its node. A conversation doesn't own its first nodes and owns all that come after. So a
node's subtree has as many leaves as members that own a leaf, and saves the bytes that its members have in turns from the
node on which they don't own: both are sums over members of numbers by conversation. Ids of members that end at a node are
joined in order by blocks of ranges, which one task hashes one after another.

Rows without conv_id are left out. Null roles and texts count as empty, and repeated rows are turns of their own. An empty
table gives no node, not even the root. Columns other than conv_id, turn, role and text may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, lean, ranked, small, table
from .jaccard_join import bound

#: Turns in a block of the running sums; cells for each prefix, and in a row of the sketch at most; cells in a part of it that
#: is shuffled; ids in a block.
BLOCK, CELLS_A_PREFIX, MOST_CELLS, PART, IDS = 1_024, 8, 1 << 25, 8_192, 4_096

#: A rebuilt conversation takes over at most this many turns, and from one of so many neighbours.
SHARED, FAMILY = 8, 5


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, i, t, bytes): each turn's place in its conversation, the digest of role and text, and the text's bytes."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    t = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    own = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), t.alias("t"), F.octet_length(text).cast("long").alias("bytes"))
    bucket = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62)))
    return ranked(own, ["conv"], bucket, [F.col("turn").asc_nulls_first(), F.col("t")], "i").drop("turn")


def plain(own: DataFrame) -> DataFrame:
    """(conv, length, pos, t, bytes) of conversations as they are, from turns()."""
    sizes = own.groupBy("conv").agg(F.count(F.lit(1)).alias("length"))
    return own.join(small(cut(sizes)), "conv").select("conv", "length", F.col("i").alias("pos"), "t", "bytes")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of conversations rebuilt: c begins with the first h turns of conversation c - c % FAMILY, h being the unsigned
    crc32 of c modulo SHARED + 1, and goes on with its own after the first h. Also (conv, length) of each conversation, as
    some have no turn left."""
    family, h = F.col("conv") - F.col("conv") % FAMILY, F.crc32(F.col("conv").cast("string").cast("binary")) % (SHARED + 1)
    first = own.filter((F.col("conv") == family) & (F.col("i") < SHARED))
    bases = first.groupBy(F.col("conv").alias("family")).agg(F.sort_array(F.collect_list(F.struct("i", "t", "bytes"))).alias("head"))  # SHARED turns at most
    sizes = own.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).withColumns({"family": family, "h": F.when(F.col("conv") == family, 0).otherwise(h).cast("int")})
    none = F.array().cast("array<struct<i:bigint,t:string,bytes:bigint>>")
    shape = sizes.join(bases, "family", "left").withColumn("head", F.slice(F.coalesce("head", none), F.lit(1), F.col("h")))
    shape = cut(shape.select("conv", "h", "head", (F.size("head") - F.col("h")).alias("shift"), (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("length")))
    heads = shape.select("conv", "length", F.inline("head")).withColumnRenamed("i", "pos")
    rest = own.join(small(shape.select("conv", "h", "shift", "length")), "conv").filter("i >= h")
    rest = rest.select("conv", "length", (F.col("i") + F.col("shift")).alias("pos"), "t", "bytes")
    return heads.unionByName(rest), shape.select("conv", "length")


def prefixes(rows: DataFrame) -> DataFrame:
    """A row for each conversation and depth from 1 on: (conv, length, depth, d1, d2, p1, p2, e1, e2, first, bytes, before):
    digests of the prefix, of its parent, and of the whole conversation, that of the first turn, bytes of the last turn's
    text and of all before it."""
    hashed = rows.withColumns({f"x{k}": F.xxhash64(F.lit(k), "pos", "t") for k in (1, 2)}).withColumn("block", F.floor(F.col("pos") / BLOCK))
    sums = hashed.groupBy("conv", "block").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("bytes").alias("bytes"), F.max(F.when(F.col("pos") == 0, F.col("x1"))).alias("x0"))
    every = Window.partitionBy("conv")
    before = every.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    starts = sums.select("conv", "block", *(F.coalesce(F.bit_xor(f"x{k}").over(before), zero).alias(f"s{k}") for k in (1, 2)), F.coalesce(F.sum("bytes").over(before), zero).alias("s0"), F.bit_xor("x1").over(every).alias("e1"), F.bit_xor("x2").over(every).alias("e2"), F.max("x0").over(every).alias("first"))
    upto = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = hashed.join(starts, ["conv", "block"]).withColumns({f"d{k}": F.bit_xor(f"x{k}").over(upto).bitwiseXOR(F.col(f"s{k}")) for k in (1, 2)} | {"upto": F.sum("bytes").over(upto) + F.col("s0")})
    return out.select("conv", "length", (F.col("pos") + 1).alias("depth"), "d1", "d2", *(F.col(f"d{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"p{k}") for k in (1, 2)), "e1", "e2", "first", "bytes", (F.col("upto") - F.col("bytes")).alias("before"))


def _counters(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """The sketch of a task's digests (d1, d2), by parts in which something was counted."""
    counts = np.zeros(2 * cells, np.uint8)
    for batch in lean(batches):
        for k in (0, 1):
            at, n = np.unique(_cell(batch.column(k).to_numpy(), k, cells), return_counts=True)
            counts[at] = np.minimum(counts[at] + n, 255)
    parts = counts.reshape(-1, min(PART, cells))
    some = np.flatnonzero(parts.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([parts[k].tobytes() for k in some], pa.binary())], ["part", "counts"])


def _cell(digest: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (digest.view(np.uint64) & np.uint64(cells - 1)).astype(np.int64) + row * cells


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of all tasks' sketches added up, as bits that tell counts over one."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            new = np.frombuffer(counts, np.uint8)
            sums[part] = np.minimum(sums[part].astype(np.uint16) + new, 255).astype(np.uint8) if part in sums else new
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.packbits(c > 1, bitorder="little").tobytes() for c in sums.values()], pa.binary())], ["part", "bits"])


def sketch(digests: DataFrame, cells: int) -> np.ndarray:
    """For each cell of both rows whether its count is over one; `cells` is a power of two. A quarter of a byte for each cell
    comes to the driver."""
    parts = digests.mapInArrow(bound(_counters, cells=cells), "part int, counts binary").repartition("part").mapInArrow(_added, "part int, bits binary")
    out = np.zeros((2 * cells // min(PART, cells), min(PART, cells) // 8), np.uint8)
    for r in parts.collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def screened(paths: DataFrame, most: int = MOST_CELLS) -> DataFrame:
    """The prefixes with whether each, its parent and its whole conversation surely have one member only. The root isn't
    taken for such a parent."""
    spark, total = paths.sparkSession, paths.count()
    slices = max(1, -(-total * CELLS_A_PREFIX // most))
    cells = min(most, 1 << max(16, (total * CELLS_A_PREFIX // slices).bit_length()))
    names = [*paths.columns, "single", "parent_single", "end_single"]
    out = None
    for s in range(slices):
        some = paths if slices == 1 else paths.filter(F.pmod(F.xxhash64("first"), F.lit(slices)) == s)
        shared = spark.sparkContext.broadcast(sketch(some.select("d1", "d2"), cells))
        told = some.mapInArrow(bound(_told, shared=shared, cells=cells), ", ".join([*(f"{n} {t}" for n, t in paths.dtypes), *(f"{n} boolean" for n in names[-3:])]))
        out = told if out is None else out.union(told)
    return out


def _told(batches: Iterator[pa.RecordBatch], shared, cells: int) -> Iterator[pa.RecordBatch]:
    bits = shared.value
    for batch in batches:
        of = {n: batch.column(k).to_numpy() for k, n in enumerate(batch.schema.names) if n in ("d1", "d2", "p1", "p2", "e1", "e2", "depth")}
        new = []
        for kind in "dpe":
            single = np.zeros(batch.num_rows, bool)
            for k in (1, 2):
                at = _cell(of[f"{kind}{k}"], k - 1, cells)
                single |= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 0
            new.append(single & (of["depth"] > 1) if kind == "p" else single)
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, new)], [*batch.schema.names, "single", "parent_single", "end_single"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (d1, d2, conv) in order, the ids of each digest joined, IDS at most in a row, with the least."""
    for batch in batches:
        d1, d2, conv = (batch.column(k).to_numpy() for k in range(3))
        cuts = np.flatnonzero((d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])) + 1
        edges = np.unique(np.concatenate([[0], cuts, [len(conv)], *([np.arange(0, len(conv), IDS)] if len(conv) > IDS else [])])).tolist()
        joined = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x[edges[:-1]]) for x in (d1, d2, conv)] + [pa.array(joined, pa.string())], ["d1", "d2", "least", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (d1, d2, least, ids) in order, the SHA-256 of each digest's ids."""
    now, sha = None, None
    out: list[tuple] = []
    for batch in batches:
        for d1, d2, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
            if (d1, d2) != now:
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                now, sha = (d1, d2), hashlib.sha256(ids.encode())
            else:
                sha.update(f",{ids}".encode())
    if now is not None:
        out.append((*now, sha.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["d1", "d2", "sha"])


def ends(members: DataFrame) -> DataFrame:
    """(d1, d2, sha) of digests at which several conversations (d1, d2, conv) end."""
    ordered = members.repartitionByRange("d1", "d2", "conv").sortWithinPartitions("d1", "d2", "conv")
    blocks = ordered.mapInArrow(_blocks, "d1 long, d2 long, least long, ids string")
    return blocks.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "least").mapInArrow(_hashed, "d1 long, d2 long, sha string")


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(rows: DataFrame, convs: DataFrame, most: int = MOST_CELLS) -> DataFrame:
    """A row for each node of the conversations' prefixes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. rows are (conv, length, pos, t, bytes), convs (conv, length) of all conversations."""
    root_of = convs.agg(F.min("conv")).first()[0]
    paths = cut(screened(cut(prefixes(rows)), most))
    zero, no = F.lit(0).cast("long"), F.lit(False)
    sha = lambda c: F.sha2(c.cast("string"), 256)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())

    # nodes that surely have one member: all is known but the owner of a parent that may be shared
    single = paths.filter("single")
    tops = single.filter(~F.col("parent_single")).select("conv", "depth", "p1", "p2", "before", "length", "end_single")
    inner = single.filter("parent_single").withColumn("parent", F.col("conv"))

    # possibly shared prefixes, the root among them
    at_root = convs.select("conv", "length", zero.alias("depth"), zero.alias("d1"), zero.alias("d2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("bytes"), zero.alias("before"), no.alias("parent_single"))
    shared = cut(paths.filter(~F.col("single")).select(at_root.columns).unionByName(at_root))
    here = F.col("depth") == F.col("length")
    nodes = shared.groupBy("d1", "d2").agg(F.min("conv").alias("owner"), F.first("depth").alias("depth"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.count(F.lit(1)).alias("n"), F.first("before").alias("before"), F.bool_and("parent_single").alias("parent_single"), F.sum(here.cast("long")).alias("ending"), F.min(F.when(here, F.col("conv"))).alias("end_conv"))
    nodes = cut(nodes)
    children = nodes.select("p1", "p2").union(tops.select("p1", "p2")).groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("kids"))
    nodes = cut(on_digest(nodes, children.toDF("q1", "q2", "kids"), "d").withColumn("kids", F.coalesce("kids", zero)))

    # by conversation: bytes before the first node that it owns, and whether it owns a leaf
    owners = nodes.groupBy(F.col("owner").alias("conv")).agg(F.min("before").alias("own"), F.max((F.col("kids") == 0) & (F.col("depth") > 0)).alias("leaf"))
    first = tops.groupBy("conv").agg(F.min("before").alias("top"), F.bool_or("end_single").alias("tail"))
    told = shared.groupBy("conv").agg(F.max(F.col("before") + F.col("bytes")).alias("all")).join(owners, "conv", "left").join(first, "conv", "left")
    told = told.select("conv", F.coalesce(F.least("own", "top"), "all").alias("from"), (F.coalesce("leaf", no) | F.coalesce("tail", no)).alias("leaf"))
    sums = shared.select("conv", "d1", "d2", "before").join(small(cut(told)), "conv").groupBy("d1", "d2").agg(F.sum(F.greatest(F.col("from") - F.col("before"), zero)).alias("saved"), F.sum(F.col("leaf").cast("long")).alias("leaves"))

    several = nodes.filter("ending > 1").select(F.col("d1").alias("q1"), F.col("d2").alias("q2"))
    ending = on_digest(shared.filter(here).select("conv", "d1", "d2"), several, "d", "inner").select("d1", "d2", "conv")
    owner_of = nodes.select(F.col("d1").alias("q1"), F.col("d2").alias("q2"), F.col("owner").alias("found"))
    full = on_digest(nodes, sums.toDF("q1", "q2", "saved", "leaves"), "d")
    full = on_digest(full, ends(ending).toDF("q1", "q2", "sha"), "d")
    full = with_parent(full.withColumn("conv", F.col("owner")), owner_of, root_of)
    digest = F.when(F.col("ending") == 0, nothing).when(F.col("ending") == 1, sha(F.col("end_conv"))).otherwise(F.col("sha"))
    leaves = F.when((F.col("depth") == 0) & (F.col("kids") == 0), F.lit(1)).otherwise(F.col("leaves"))
    exact = full.select("owner", "depth", F.when(F.col("depth") > 0, F.col("parent")), "n", "kids", leaves.cast("long"), "saved", digest)
    alone = inner.select("conv", "depth", "parent", "length").unionByName(with_parent(tops.withColumn("parent_single", no), owner_of, root_of).select("conv", "depth", "parent", "length"))
    one = F.lit(1).cast("long")
    tails = alone.select("conv", "depth", "parent", one, F.when(here, zero).otherwise(one), one, zero, F.when(here, sha(F.col("conv"))).otherwise(nothing))
    return exact.toDF(*COLUMNS).union(tails.toDF(*COLUMNS))


def on_digest(left: DataFrame, right: DataFrame, kind: str, how: str = "left") -> DataFrame:
    """left with what right (q1, q2, ...), unique in these, has of its digest."""
    return left.join(small(cut(right)), (F.col(f"{kind}1") == F.col("q1")) & (F.col(f"{kind}2") == F.col("q2")), how).drop("q1", "q2")


def with_parent(nodes: DataFrame, owner_of: DataFrame, root_of: int | None) -> DataFrame:
    """nodes with the owner of their parents: the root's is known, and a parent with one member is its child's owner's."""
    sought = (F.col("depth") > 1) & ~F.col("parent_single")
    keyed = nodes.withColumns({f"w{k}": F.when(sought, F.col(f"p{k}")) for k in (1, 2)})
    near = F.when(F.col("depth") == 1, F.lit(root_of).cast("long")).when(F.col("parent_single"), F.col("conv"))
    beyond = keyed.filter(sought)
    return keyed.filter(~sought).withColumn("parent", near).unionByName(on_digest(beyond, owner_of, "w").withColumn("parent", F.col("found")).drop("found")).drop("w1", "w2")


#: The same rows by lists of turns as keys. CRC-32 by bits, with its polynomial (a fixed value).
OP13_SQL = f"""
WITH given AS (SELECT CAST(conv_id AS BIGINT) AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(strlen(r) || ':' || r || t)) - 1 AS i, r, t FROM given),
crc AS (SELECT c, n, list_reduce(flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [ord(x), -1, -1, -1, -1, -1, -1, -1, -1])), lambda y, x: CASE WHEN x >= 0 THEN xor(y, CAST(x AS BIGINT)) WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, 4294967295) AS y FROM (SELECT c, count(*) AS n FROM given GROUP BY c)),
shape AS (SELECT a.c, a.c - a.c % {FAMILY} AS f, CASE WHEN a.c % {FAMILY} = 0 THEN 0 ELSE xor(a.y, 4294967295) % {SHARED + 1} END AS h, coalesce(b.n, 0) AS m FROM crc a LEFT JOIN crc b ON b.c = a.c - a.c % {FAMILY}),
turns AS (SELECT s.c, o.i AS pos, o.r, o.t FROM shape s JOIN own o ON o.c = s.f AND o.i < s.h UNION ALL SELECT o.c, o.i - s.h + least(s.h, s.m), o.r, o.t FROM own o JOIN shape s USING (c) WHERE o.i >= s.h),
paths AS (SELECT c, pos + 1 AS depth, list({{'r': r, 't': t}}) OVER (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING) AS path, strlen(t) AS bytes FROM turns UNION ALL SELECT c, 0, CAST([] AS STRUCT(r VARCHAR, t VARCHAR)[]), 0 FROM shape),
ended AS (SELECT *, depth = max(depth) OVER (PARTITION BY c) AS ends FROM paths),
nodes AS (SELECT path, min(c) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(bytes) AS bytes, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM ended GROUP BY path),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS kids FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(k.kids, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (path)),
above AS (SELECT path[1:d] AS path, sum((n_convs - 1) * bytes) AS saved, sum(CAST(n_children = 0 AS INTEGER)) AS leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_nodes) GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(a.leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN above a USING (path) LEFT JOIN full_nodes p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each node of the trie of all conversations, rebuilt so that families of them share turns."""
    rows, convs = rebuilt(cut(turns(table(spark, sf_dir, "conversations"))))
    return trie(rows, convs)
