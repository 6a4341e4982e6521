"""Sharding by balanced label propagation.

Documents with equal texts are linked (each to the hub of its group). Shards start from a hash of the document; then rounds of
joins move linked documents towards their neighbours' shards. In a round, the labels of each group are counted; a group that
is in several shards names the one that holds most of it (by a hash of group, shard and round if several do), and its members
elsewhere wish to be there. Wishes from one shard to another are granted as far as as many go the other way, and beyond that
as far as the shard has room, its even share of all rows less the linked rows in it; those of larger groups come first. Only
counts of wishes by shards and size of the group come to the driver. Each move takes a document from a smaller or equal part
of its group to a larger or equal one, so rounds come to an end: with one that moves nothing, or after `rounds` of them.

Groups that are still cut then are packed: the larger groups first, into the shards they name, or the ones with most room.
Groups larger than a shard fill empty shards and go on in another one; what fits nowhere is cut last, when all other
groups are placed. Then each shard has less room than any such group has rows, so there are fewer of them than shards,
groups larger than a shard apart. At the end surplus unlinked rows go to the shards that lack some, so that counts are
at most one apart: law `rows`. As linked rows never exceed a shard's share, this cuts no group.

Ties are broken by doc_id, text and, for rows alike in both, their place among those, so the shards don't depend on how
the rows were dealt to tasks. A null text has no bytes and is linked with other empty ones. Repeated rows are rows of their
own. Empty tables give empty results; columns other than id and text may have any names.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, done, occurrences, ranked, small, table, unit

#: Rows that one window of the ranking holds, on average, at most, and rows of ranges of groups that are broadcast.
WINDOW_ROWS, BROADCAST_RANGES = 50_000, 500_000
#: Rounds of propagation, at most, and rows of groups whose wishes are ranked row by row, not group by group.
ROUNDS, SPREAD = 8, 1_000


def deal(classes: dict[tuple[int, int], int], want: list[int]) -> tuple[list[tuple], list[tuple]]:
    """Where groups go, from the number of groups by (named shard, size) and the rows that each shard is to have at most:
    ranges (named, size, from, upto, shard) of places of whole groups among those of their class, and ranges
    (named, size, place, from, upto, shard) of rows of the groups that are cut."""
    room, whole, parts, late = list(want), [], [], []
    shards = range(len(want))
    ends: dict[int, list[tuple[int, int, int, int]]] = {}  # of groups larger than a shard: (named, size, place, rows placed) by rows left
    heap = [-n for n in {n for _, n in classes}]
    heapq.heapify(heap)

    def emptiest() -> int:
        return max(shards, key=lambda s: (room[s], -s))

    def cut_off(left: int, named: int, n: int, place: int, begun: int, to: int) -> tuple[int, int]:
        some = min(left, room[to])
        parts.append((named, n, place, begun, begun + some, to))
        room[to] -= some
        return left - some, begun + some

    while heap:
        n = -heapq.heappop(heap)
        while heap and -heap[0] == n:
            heapq.heappop(heap)
        for named, size, place, begun in ends.pop(n, []):
            if room[to := emptiest()] >= n:
                cut_off(n, named, size, place, begun, to)
            else:
                late.append((n, named, size, place, begun))
        at = [0] * len(want)
        for s in shards:
            at[s] = min(classes.get((s, n), 0), room[s] // n)
            room[s] -= at[s] * n
            if at[s]:
                whole.append((s, n, 0, at[s], s))
        for s in shards:
            while (count := classes.get((s, n), 0) - at[s]) > 0 and room[to := emptiest()] >= n:
                some = min(count, room[to] // n)
                whole.append((s, n, at[s], at[s] + some, to))
                at[s], room[to] = at[s] + some, room[to] - some * n
            for place in range(at[s], classes.get((s, n), 0)):
                left, begun = n, 0
                while left > max(want) and room[to := emptiest()] == want[to] > 0:
                    left, begun = cut_off(left, s, n, place, begun, to)
                if not begun:
                    late.append((n, s, n, place, 0))
                elif left:
                    ends.setdefault(left, []).append((s, n, place, begun))
                    heapq.heappush(heap, -left)
    for left, named, size, place, begun in late:
        while left:
            left, begun = cut_off(left, named, size, place, begun, emptiest())
    return whole, parts


def quotas(wishes: dict[tuple[int, int, int], int], room: list[int]) -> dict[tuple[int, int, int], int]:
    """How many of the wishes by (from, to, size of the group) are granted: between two shards as many as go the other way,
    then as many as there is room for; the larger groups first."""
    both: dict[tuple[int, int], int] = {}
    for (a, b, _), n in wishes.items():
        both[a, b] = both.get((a, b), 0) + n
    free, granted = list(room), {}
    for (a, b), n in sorted(both.items()):
        granted[a, b] = min(n, both.get((b, a), 0))
        more = max(0, min(n - granted[a, b], free[b]))
        granted[a, b], free[b] = granted[a, b] + more, free[b] - more
    out = {}
    for (a, b, size), n in sorted(wishes.items(), key=lambda w: (w[0][:2], -w[0][2])):
        out[a, b, size] = min(n, granted[a, b])
        granted[a, b] -= out[a, b, size]
    return {k: n for k, n in out.items() if n}


def propagated(linked: DataFrame, want: list[int], rounds: int) -> tuple[DataFrame, list[int]]:
    """linked (_row, doc_id, _nth, _key, shard) with new shards after so many rounds, or the first one that moves nothing;
    and the cut, the number of parts of groups beyond one each, before each round and at the end."""
    cuts: list[int] = []
    for r in range(rounds + 1):
        held = linked.groupBy("_key", "shard").agg(F.count(F.lit(1)).alias("_n")).withColumn("_tie", unit("_key", "shard", seed=100 + r))
        named = held.groupBy("_key").agg(F.sum("_n").alias("_size"), F.count(F.lit(1)).alias("_parts"), F.max_by("shard", F.struct("_n", "_tie")).alias("_named"))
        named = cut(named.filter("_parts > 1"))
        cuts.append(named.agg(F.coalesce(F.sum(F.col("_parts") - 1), F.lit(0))).first()[0])
        if r == rounds or not cuts[-1]:
            done(named)
            break
        wishing = cut(linked.join(small(named.select("_key", "_size", "_named")), "_key").filter("shard <> _named"))
        wishes = {(x["shard"], x["_named"], x["_size"]): x["count"] for x in wishing.groupBy("shard", "_named", "_size").count().collect()}
        filled = {x["shard"]: x["count"] for x in linked.groupBy("shard").count().collect()}
        granted = quotas(wishes, [max(0, n - filled.get(s, 0)) for s, n in enumerate(want)])
        if not granted:
            done(named, wishing)
            break
        told = linked.sparkSession.createDataFrame([(*k, n, n == wishes[k]) for k, n in granted.items()], "_f int, _t int, _s long, _quota long, _every boolean")
        asked = wishing.join(F.broadcast(told), (F.col("shard") == F.col("_f")) & (F.col("_named") == F.col("_t")) & (F.col("_size") == F.col("_s")))  # a row for two shards and a size
        buckets = max(32, sum(wishes.values()) // WINDOW_ROWS + 1)
        dealt = F.when(F.col("_s") > SPREAD, F.xxhash64("doc_id", "_nth")).otherwise(F.xxhash64("_key"))
        some = ranked(asked.filter("not _every"), ["_f", "_t", "_s"], F.pmod(dealt, F.lit(buckets)).cast("int"), [F.col("_key"), F.col("doc_id"), F.col("_nth")], "_place").filter(F.col("_place") < F.col("_quota"))
        moves = cut(asked.filter("_every").select("_row", "_named").union(some.select("_row", "_named")))
        before = linked
        moved = before.join(small(moves.toDF("_moved", "_to")), F.col("_row") == F.col("_moved"), "left")
        linked = cut(moved.select("_row", "doc_id", "_nth", "_key", F.coalesce("_to", "shard").alias("shard")))
        done(named, wishing, moves)
        if r:
            done(before)
    return linked, cuts


def packed(linked: DataFrame, want: list[int]) -> DataFrame:
    """_row and shard of linked (_row, doc_id, _nth, _key, shard), with groups whole where they fit; no shard has more rows
    than it is to have."""
    spark = linked.sparkSession
    held = linked.groupBy("_key", "shard").agg(F.count(F.lit(1)).alias("_n"))
    named = held.withColumn("_tie", unit("_key", "shard", seed=100)).groupBy("_key").agg(F.sum("_n").alias("_size"), F.max_by("shard", F.struct("_n", "_tie")).alias("_named"))
    named = cut(named)
    classes = {(r["_named"], r["_size"]): r["count"] for r in named.groupBy("_named", "_size").count().collect()}  # sizes differ, so at most shards times the root of twice the rows
    whole, parts = deal(classes, want)
    buckets = max(1, sum(classes.values()) // WINDOW_ROWS + 1)
    placed = ranked(named, ["_named", "_size"], F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int"), [F.col("_key")], "_place")
    ranges = spark.createDataFrame(whole, "_w int, _m long, _from long, _upto long, _to int")
    within = (F.col("_named") == F.col("_w")) & (F.col("_size") == F.col("_m")) & (F.col("_place") >= F.col("_from")) & (F.col("_place") < F.col("_upto"))
    ranges = F.broadcast(ranges) if len(whole) <= BROADCAST_RANGES else ranges
    placed = cut(placed.join(ranges, within, "left").select("_key", "_named", "_size", "_place", "_to"))  # so that Spark can split a key with very many rows in the join
    there = cut(linked.join(placed.select("_key", "_to"), "_key").select("_row", "_key", "_to", "doc_id", "_nth"))
    of = spark.createDataFrame(parts, "_named int, _size long, _place long, _from long, _upto long, _part int")
    pieces = cut(placed.filter("_to is null").join(F.broadcast(of), ["_named", "_size", "_place"]).select(F.col("_key").alias("_cut"), "_from", "_upto", "_part"))
    torn = there.filter("_to is null").select("_row", "_key", "doc_id", "_nth")
    torn = ranked(torn, ["_key"], F.pmod(F.xxhash64("doc_id", "_nth"), F.lit(max(32, sum(n for _, n in classes) // WINDOW_ROWS + 1))).cast("int"), [F.col("doc_id"), F.col("_nth")], "_turn")
    torn = torn.join(F.broadcast(pieces), (F.col("_key") == F.col("_cut")) & (F.col("_turn") >= F.col("_from")) & (F.col("_turn") < F.col("_upto")))
    return there.filter("_to is not null").select("_row", F.col("_to").alias("shard")).union(torn.select("_row", F.col("_part").alias("shard")))


def balanced_shards(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """A row for each document: doc_id, size, text_crc32, shard, slot. With no rounds, rows stay where their hash puts them."""
    whole = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole).cast("long").alias("text_crc32"), F.unhex(F.md5(whole)).alias("_key"))
    base = occurrences(cut(base), ["doc_id", "_key"], "_nth").withColumn("_row", F.monotonically_increasing_id())
    base = cut(base.withColumn("shard", F.pmod(F.xxhash64("doc_id", "_key", "_nth"), F.lit(shards)).cast("int")))
    groups = base.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    linked = cut(base.select("_row", "doc_id", "_nth", "_key", "shard").join(cut(groups.select("_key")), "_key", "left_semi"))
    total = base.count()
    want = [total // shards + (s < total % shards) for s in range(shards)]
    moved, cuts = propagated(linked, want, rounds)
    filled = {r["shard"]: r["count"] for r in moved.groupBy("shard").count().collect()}
    if rounds and (cuts[-1] or any(filled.get(s, 0) > n for s, n in enumerate(want))):
        moved = packed(moved, want)
    moved = moved.select("_row", F.col("shard").alias("_home"))
    now = base.join(moved, "_row", "left").withColumn("_linked", F.col("_home").isNotNull()).withColumn("shard", F.coalesce("_home", "shard")).drop("_home")
    # _home is null in rows without an equal, and they may be moved first
    buckets = max(32, total // (shards * WINDOW_ROWS) + 1)
    bucket = F.col("_linked").cast("int") * buckets + F.pmod(F.xxhash64("doc_id", "_key", "_nth"), F.lit(buckets)).cast("int")
    order = [F.col("doc_id"), F.col("_key"), F.col("_nth")]
    now = cut(ranked(now, ["shard"], bucket, order, "_place"))
    have = {r["shard"]: r["count"] for r in now.groupBy("shard").count().collect()}
    over = [max(0, have.get(s, 0) - want[s]) for s in range(shards)]
    lack = [max(0, want[s] - have.get(s, 0)) for s in range(shards)]
    number, to = F.lit(None).cast("long"), F.lit(0)
    for s in range(shards):
        number = F.when((F.col("shard") == s) & (F.col("_place") < over[s]), F.col("_place") + sum(over[:s])).otherwise(number)
    for s in range(shards):
        to = F.when(F.col("_number") >= sum(lack[:s]), F.lit(s)).otherwise(to) if lack[s] else to
    even = now.withColumn("_number", number).withColumn("shard", F.when(F.col("_number").isNotNull(), to).otherwise(F.col("shard")))
    placed = ranked(even.select("doc_id", "size", "text_crc32", "shard", "_key", "_nth"), ["shard"], F.pmod(F.xxhash64("doc_id", "_key", "_nth"), F.lit(buckets)).cast("int"), order, "slot")
    return placed.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def op10_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of documents, in eight shards."""
    out = balanced_shards(table(spark, sf_dir, "documents"))
    return out.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")}).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
