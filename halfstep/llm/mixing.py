"""Mixing sources to target weights by Pareto order sampling.

Sources share all words by weight (1, 2, 3, repeating, by source in code-point order, null last), each up to a cap of
its own size times max_copies, the excess going to the others by weight. With r = target / size of a source, every
document is taken floor(r) times for certain; the rest of the target is filled by a sample of fixed size in words:
documents are ranked by the odds of a random number over the odds of their inclusion (Pareto sampling), and the first
ones are taken once more until the words are nearest to the rest.

The odds of inclusion are f / (1 - f) * (size / mean size) ** exponent, f being the rest over the source's size.
Random numbers come from doc_id, text and, for rows alike in these and the source, their place among those, so reruns
agree and repeated rows are drawn on their own. Ranks are summed by bins of even width; only the bin in which a source's
words run out is sorted. Whether a row is taken is told where it is, from the table of sources, unless it is in that bin
or repeated: texts of those alone are shuffled.

Null texts have size 0; documents of size 0 go with the certain copies only. Empty tables give empty results. Columns
other than id, text and source are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, numbered, occurrences, ranked, small, table, unit

#: Bins over which a source's ranks are summed.
BINS = 4096


def targets(sizes: DataFrame, source: str = "source", max_copies: float = 3.0) -> DataFrame:
    """sizes (source, source_size) with target. The share of a unit of weight grows as sources above their cap are held
    there, until no other is above; four numbers come to the driver each time."""
    t = numbered(sizes, [F.col(source).asc_nulls_last()], "_nth").withColumns({"_w": (F.col("_nth") % 3 + 1).cast("double"), "_cap": F.col("source_size") * max_copies})
    t = cut(t)
    total, weights = t.agg(F.sum("source_size"), F.sum("_w")).first()
    held, share = -1, (total or 0) / (weights or 1)
    while True:
        above = F.col("_w") * share > F.col("_cap")
        count, caps, of = t.filter(above).agg(F.count(F.lit(1)), F.sum("_cap"), F.sum("_w")).first()
        if count == held or not weights or weights == of:
            break
        held, share = count, (total - (caps or 0)) / (weights - (of or 0))
    return t.select(source, "source_size", F.least(F.col("_cap"), F.col("_w") * share).alias("target"))


def _sized(docs: DataFrame, doc_id: str, text: str, source: str, *more: Column) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(*more, F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("_key"))


def _binned(rows: DataFrame, sources: DataFrame, exponent: float, seed: int, nth: Column) -> DataFrame:
    """rows (doc_id, source, size, _key) with their source's numbers, the rank _q of those that take part in the sample,
    and its bin."""
    t = rows.join(small(sources), rows["source"].eqNullSafe(sources["_source"]))
    u, f = unit("doc_id", "_key", nth, seed=seed), F.col("_rest") / F.col("source_size")
    odds = f / (1 - f) * F.pow(F.col("size") / (F.col("source_size") / F.col("_docs")), F.lit(exponent))
    takes_part = (F.col("size") > 0) & (F.col("_rest") >= 0.5) & (f < 1)
    t = t.withColumn("_q", F.when(takes_part, u / (1 - u) / odds))
    # q -> q / (1 / f - 1 + q) is even over (0, 1) for equal odds, and keeps the order
    return t.withColumn("_bin", F.when(F.col("_q").isNotNull(), F.least(F.lit(BINS - 1), F.floor(BINS * F.col("_q") / ((1 - f) / f + F.col("_q"))))).cast("int"))


class Plan:
    """What a mix takes: the slim rows, the table of sources with the bin in which each one's words run out, and the rows
    of those bins that are taken once more."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, source: str, max_copies: float, exponent: float, seed: int):
        self.exponent, self.seed = exponent, seed
        base = cut(_sized(docs, doc_id, text, source))
        self.base = base = cut(occurrences(base, ["doc_id", "source", "_key"], "_nth"))
        by = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("_docs"))
        by = cut(by)
        both = targets(by.select("source", "source_size"), "source", max_copies).join(by.select(F.col("source").alias("_s"), "_docs"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
        both = both.withColumn("_whole", F.floor(ratio + 1e-12)).withColumn("_rest", F.greatest(F.lit(0.0), F.col("target") - F.col("_whole") * F.col("source_size")))
        both = cut(both.withColumnRenamed("source", "_source"))
        t = _binned(base, both, exponent, seed, F.col("_nth"))
        bins = t.filter("_bin is not null").groupBy("_source", "_bin").agg(F.sum("size").alias("_words"), F.first("_rest").alias("_goal"))
        running = F.sum("_words").over(Window.partitionBy("_source").orderBy("_bin"))
        edge = bins.withColumn("_upto", running).filter("_upto > _goal").groupBy("_source").agg(F.min_by(F.struct("_bin", (F.col("_upto") - F.col("_words")).alias("_before")), "_bin").alias("_edge"))
        edge = edge.select(F.col("_source").alias("_e"), F.col("_edge._bin").alias("_edge_bin"), F.col("_edge._before").alias("_before"))
        self.sources = cut(both.join(edge, F.col("_source").eqNullSafe(F.col("_e")), "left").drop("_e"))
        close = self.rows(base, F.col("_nth")).filter("_bin = _edge_bin")
        ranks = Window.partitionBy("_source").orderBy("_q", "doc_id", "_key", "_nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = F.col("_before") + F.sum("size").over(ranks)
        # the document that crosses the rest is taken if that leaves less of a gap
        self.close = cut(close.withColumn("copies", F.col("_whole") + (upto - F.col("_rest") <= F.col("size") / 2).cast("long")))

    def rows(self, rows: DataFrame, nth: Column) -> DataFrame:
        return _binned(rows, self.sources, self.exponent, self.seed, nth)

    def sure(self, t: DataFrame) -> DataFrame:
        """Rows outside the bins in which words run out, with their copies."""
        more = F.col("_bin").isNotNull() & (F.col("_edge_bin").isNull() | (F.col("_bin") < F.col("_edge_bin")))
        return t.filter("_bin is null or _edge_bin is null or _bin <> _edge_bin").withColumn("copies", F.col("_whole") + more.cast("long"))


def pareto_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", max_copies: float = 3.0, exponent: float = 0.5, seed: int = 11) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, copies and taken (copies by size)."""
    plan = Plan(docs, doc_id, text, source, max_copies, exponent, seed)
    t = plan.sure(plan.rows(plan.base, F.col("_nth"))).unionByName(plan.close)
    return t.select("doc_id", "source", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"), (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", max_copies: float = 3.0, exponent: float = 0.5, seed: int = 11) -> DataFrame:
    """The mixed rows of docs: each as often as it is taken, with all its columns."""
    plan = Plan(docs, doc_id, text, source, max_copies, exponent, seed)
    keys = ["doc_id", "source", "_key"]
    alike = cut(plan.base.filter("_nth > 0").select(*keys).distinct())
    # a row goes as a struct, so its columns can have any names
    rows = _sized(docs, doc_id, text, source, F.struct("*").alias("_whole_row"))

    def match(other: DataFrame) -> Column:
        return F.col("doc_id").eqNullSafe(other["_i"]) & F.col("source").eqNullSafe(other["_s"]) & (F.col("_key") == other["_k"])

    named = [F.col(k).alias(n) for k, n in zip(keys, ("_i", "_s", "_k"), strict=True)]
    every, repeated = rows, not alike.isEmpty()
    if repeated:
        same = alike.select(*named)
        rows = every.join(small(same), match(same), "left_anti")
    t = plan.rows(rows, F.lit(0).cast("long"))
    taken = cut(plan.close.filter("copies > 0").select(*named, "copies"))
    near = small(taken)
    if near is not taken:  # few rows are where words run out: one pass tells all
        at_edge = F.coalesce(F.col("_bin") == F.col("_edge_bin"), F.lit(False))
        told = t.withColumn("_edge", at_edge).join(near.withColumnRenamed("copies", "_given"), F.col("_edge") & match(near), "left")
        more = (F.col("_bin").isNotNull() & (F.col("_edge_bin").isNull() | (F.col("_bin") < F.col("_edge_bin")))).cast("long")
        out = told.select("_whole_row", F.when(F.col("_edge"), F.coalesce("_given", F.lit(0))).otherwise(F.col("_whole") + more).alias("copies"))
    else:
        out = plan.sure(t).select("_whole_row", "copies")
        out = out.unionByName(t.filter("_bin = _edge_bin").join(taken, match(taken)).select("_whole_row", "copies"))
    if repeated:
        # rows alike in id, source and text share their copies: each gets as many, the first ones one more
        picks = plan.sure(plan.rows(plan.base, F.col("_nth"))).unionByName(plan.close).join(small(same), match(same), "left_semi")
        picks = cut(picks.groupBy(*keys).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")).select(*named, "_copies", "_rows"))
        many = cut(every.join(small(picks), match(picks)).withColumn("_row", F.monotonically_increasing_id()))
        many = ranked(many, keys, F.pmod(F.xxhash64("_row"), F.lit(64)).cast("int"), [F.col("_row")], "_place")
        each = F.floor(F.col("_copies") / F.col("_rows"))
        out = out.unionByName(many.select("_whole_row", (each + (F.col("_place") < F.col("_copies") - each * F.col("_rows")).cast("long")).alias("copies")))
    out = out.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long"))))
    return out.select("_whole_row.*")


def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of documents."""
    return pareto_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
