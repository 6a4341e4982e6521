"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, done


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one batch after another as stars around the least node that the batch joins them to."""
    for batch in batches:
        a, b = (batch.column(k).to_numpy() for k in (0, 1))
        nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = index[: len(a)], index[len(a) :]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[x], root[y])
            new = root.copy()
            np.minimum.at(new, root[x], low)
            np.minimum.at(new, root[y], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        out = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(nodes[root[out]])], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b): the least node that links reach from it; roots are left out.

    Batches are contracted to stars on their own; then large-star and small-star rounds alternate until nothing changes,
    which takes few rounds however long the chains are."""
    stars = "u long, v long"
    e = cut(links.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).filter("u <> v").mapInArrow(_contract, stars).distinct())
    seen = None
    while True:
        both, was = e.union(e.select("v", "u").toDF("u", "v")), e
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(both.join(low, "u").filter("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        rest = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(rest.union(least.toDF("u", "v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        done(was, low, large, least)
        state = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen:
            return e.toDF("node", "root")
        seen = state
