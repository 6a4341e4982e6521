"""Near-duplicate groups by SuperMinHash.

A document's set is its distinct shingles of `words` words (64-bit hashes); equal sets are one class. For each element of a
set, ranks of the SLOTS slots are drawn as a permutation, made step by step: step j gives one more slot of the element, with
the value j plus a fraction. A slot keeps the least value of all elements. As an element's ranks are a permutation, the slots'
values vary less than those of independent hashes. No later step can lower a slot once all are filled, so a set stops after
few steps: all elements of many sets take a step at once in numpy, and sets whose slots are filled leave.

The slots are cut into BANDS bands; classes alike in a band share a bucket. Two sets of similarity 0.85 miss each other in all
bands with a probability of (1 - 0.85^5)^40, below 1e-10. Buckets named after the same least class are one group. In a group,
classes that agree in ALIKE slots or more (at similarity 0.85 fewer do with a probability below 1e-12) are joined by
union-find, which needs the signatures only; of those components the whole texts meet, and links are confirmed on full sets
and joined by union-find (`forest`, `_linked` of the n-gram Jaccard join). Groups that are more than a task is to hold are
dealt into blocks there. What is written are forests, fewer pairs than there are classes, however many copies a group has.

Texts that are null or have no word have an empty set, link with nothing, and are their own component. Repeated rows are rows
of one class. A null doc_id is never the smallest one unless all others are null too. Empty tables give empty results;
columns other than id and text may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, done, lean, small, table
from .components import components
from .jaccard_join import BLOCK_ROWS, _linked, bound, forest, in_blocks, key_of, mixed, runs, shingle_sets, text_hash, with_texts
from .langid import chunks

WORDS, PERCENT, BANDS, BAND = 3, 85, 40, 5
SLOTS = BANDS * BAND
#: Slots in which classes agree to be compared on their sets; classes of a group that a task compares; characters at once.
ALIKE, GROUP_ROWS, CHUNK = 130, 4_096, 500_000

_EMPTY = np.uint64((1 << 64) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """A row of slots for each set of 64-bit hashes, none of them empty: values with the step in the upper 8 bits and the
    fraction below. At most 256 slots."""
    out = np.full((len(sets), slots), _EMPTY)
    flat = out.reshape(-1)
    sizes = np.array([len(s) for s in sets], np.int64)
    elements, owner = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), sizes)
    ranks, step = None, 0
    while len(elements):
        a, b = (mixed(elements ^ mixed(np.full(1, 2 * step + k, np.uint64))) for k in (1, 2))
        pick = step + ((b >> np.uint64(32)) * np.uint64(slots - step) >> np.uint64(32)).astype(np.int64)
        if ranks is None:
            slot = pick
        else:
            row = np.arange(len(elements))
            slot = ranks[row, pick].astype(np.int64)
            ranks[row, pick] = ranks[row, step]  # the two places change
        np.minimum.at(flat, owner * slots + slot, (np.uint64(step) << np.uint64(56)) | (a >> np.uint64(8)))
        going = (out == _EMPTY).any(1)[owner]
        if ranks is None:
            ranks = np.repeat(np.arange(slots, dtype=np.uint8)[None, :], int(going.sum()), 0)
            ranks[np.arange(len(ranks)), pick[going]] = 0
            elements, owner = elements[going], owner[going]
        elif not going.all():
            ranks, elements, owner = ranks[going], elements[going], owner[going]
        step += 1
    return out


def digests(signature: np.ndarray) -> np.ndarray:
    """16 bits for each slot, by which slots are compared."""
    return (mixed(signature) >> np.uint64(48)).astype(np.uint16)


def band_keys(digest: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key of each band of each row."""
    parts = digest.reshape(len(digest), bands, -1).astype(np.uint64)
    keys = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64) * _STEP), parts.shape[:2])
    for k in range(parts.shape[2]):
        keys = mixed(keys ^ (parts[:, :, k] + np.uint64(1)))
    return keys


def scan(docs: DataFrame, doc_id: str, text: str, words: int = WORDS) -> DataFrame:
    """(doc_id, th, n, key, digest) of each document: hash of the text, size and hash of its set, and the set's digests where
    the task hasn't told them yet."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *T._parse_datatype_string("th binary, n long, key binary, digest binary").fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in lean(batches):
            at = 0
            for part in chunks(batch.column(2), CHUNK):
                sets = shingle_sets(part.to_pylist(), words)
                keys = [key_of(s) if len(s) else None for s in sets]
                told: list[bytes | None] = [None] * len(sets)
                new = []
                for k, key in enumerate(keys):
                    if key is not None and key not in met:
                        new.append(k)
                        if len(met) < 100_000:
                            met.add(key)
                for k, d in zip(new, digests(signatures([sets[k] for k in new])), strict=True):
                    told[k] = d.tobytes()
                m = len(sets)
                columns = [batch.column(0).slice(at, m), batch.column(1).slice(at, m), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(told, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)
                at += m

    return docs.select(F.col(doc_id), text_hash(text).alias("th"), F.col(text)).mapInArrow(rows, schema)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (node, digest), a row (band, node) for each band."""
    for batch in lean(batches):
        digest = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array(band_keys(digest).view(np.int64).ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["band", "node"])


def joined(digest: np.ndarray, root: np.ndarray, side: np.ndarray, least: int = ALIKE) -> list[tuple[int, int]]:
    """Pairs of rows that join all rows which agree in `least` slots or more, as far as their roots don't join them already.
    Rows of side 2 meet each other, those of sides 0 and 1 the other side. A row that has joined is compared only with rows
    that haven't joined its component, so copies cost little."""
    _, label = np.unique(root, return_inverse=True)
    order = np.argsort(label, kind="stable")
    begin = np.searchsorted(label[order], np.arange(label.max(initial=-1) + 2))
    links: list[tuple[int, int]] = []
    left = np.ones(len(root), bool)  # not in a component yet
    for start in range(len(root)):
        if not left[start]:
            continue
        queue = order[begin[label[start]] : begin[label[start] + 1]].tolist()
        left[queue] = False
        while queue:
            row = queue.pop()
            others = np.flatnonzero(left if side[row] == 2 else left & (side != side[row]))
            if not len(others):
                continue
            near = others[(digest[others] == digest[row]).sum(1) >= least]
            for other in near.tolist():
                if left[other]:
                    links.append((row, other))
                    more = order[begin[label[other]] : begin[label[other] + 1]]
                    left[more] = False
                    queue += more.tolist()
    return links


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, block, side, node, root, digest), ordered by g and block: a forest of pairs (a, b) of alike classes."""
    for batch in lean(runs(batches, 2)):
        g, block, side, node, root = (batch.column(k).to_numpy() for k in range(5))
        digest = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint16).reshape(-1, SLOTS)
        edges = np.concatenate([[0], np.flatnonzero((g[1:] != g[:-1]) | (block[1:] != block[:-1])) + 1, [len(g)]])
        found = [(a + i, a + j) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) for i, j in joined(digest[a:b], root[a:b], side[a:b])]
        at = np.array(found, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(node[at[:, k]]) for k in (0, 1)], ["a", "b"])


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (the smallest doc_id that links reach), kept."""
    rows = cut(scan(docs, doc_id, text, words).withColumn("row", F.monotonically_increasing_id()))
    twice = cut(rows.groupBy("th", "doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("th", "doc_id"))
    heads = rows.filter("key is not null").groupBy("key").agg(F.min(F.struct(F.col("digest").isNull().alias("none"), "row", "th", "doc_id", "n", "digest")).alias("_h"))
    classes = cut(heads.select("key", F.col("_h.row").alias("node"), "_h.th", F.col("_h.doc_id").alias("id"), "_h.n", "_h.digest"))
    bands = classes.select("node", "digest").mapInArrow(_bands, "band long, node long")
    buckets = cut(bands.groupBy("band").agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("g")).filter("_n > 1").select("band", "g"))
    grouped = bands.join(small(buckets), "band").select("g", "node").distinct()
    members = cut(grouped.join(classes.select("node", "digest", F.lit(2 * SLOTS).cast("long").alias("size")), "node"))
    near = forest(members, GROUP_ROWS, lambda b: cut(in_blocks(b).mapInArrow(_alike, "a long, b long")))
    done(members, buckets)
    of = components(near)
    groups = of.select(F.col("root").alias("g"), "node").union(of.select("root", "root").distinct())
    close = cut(groups.join(classes.select("node", "th", "id", (F.col("n") * 8).alias("size")), "node"))
    verify = bound(_linked, words=words, percent=percent)
    links = forest(close, BLOCK_ROWS, lambda b: cut(in_blocks(with_texts(b, docs, doc_id, text, twice)).mapInArrow(verify, "a long, b long")))
    labels = cut(classes.select("key", "node").join(components(links), "node", "left").select("key", F.coalesce("root", "node").alias("root")))
    found = cut(rows.select("doc_id", "n", "key").join(small(labels), "key", "left"))
    least = cut(found.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("_least")))
    out = found.join(small(least), "root", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of documents."""
    return near_components(table(spark, sf_dir, "documents"))
