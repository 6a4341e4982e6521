"""N-gram Jaccard join with count-vector R-trees.

A document's set is its distinct shingles of `words` words (64-bit hashes). Two documents link when the Jaccard similarity
of their sets is at least `percent` in a hundred: four words and 85 unless told otherwise, as op8 has it. Equal sets are
one class; classes are what is compared.

Each class has tokens, so chosen that linked sets share one. Of a set of under LONG shingles they are its
(1 - percent / 100) n + 1 rarest ones. A longer set, in which some of those would be shared by chance, is cut by the
hashes of its shingles into more parts than linked sets can differ in; one part at least is then the same in both, and the
parts, hashed, are its tokens (see parts_of). Classes that share a token form a group, named by the least class of the
token. How often shingles occur, which only sets their order, is counted over all documents in BUCKETS counters. Shingles are hashed into GROUPS groups, and the counts by group are a class's point (long sets
have more groups, and points with fewer when they are packed into the tree). The overlap of two sets is at most the sum of the coordinate minima of their points, and with a box of points at most that of
the minima with its upper corner.

First the points of each group meet in a task, where an R-tree over them is joined with itself under that bound; it gives a
forest of pairs that the bound allows, whose components are all that links can connect. Then the whole texts of such a
component meet in a task, each text once. Pairs that survive the bound with more groups (FINE) are verified there on the
sets, likely copies (neighbours in orders by least hashes) first; pairs within a component are passed over from then on.
Either step writes fewer pairs than it has classes: what is written grows with the classes, not with the pairs, however
many copies a group has.

What is more than a task is to hold is dealt into blocks twice, by two hashes, which joins nearly all copies. In a second
round the classes outside a group's largest component meet all classes of the group, block by block, so nothing between
components is lost.

Links come as verified pairs of classes that span each component, with each document's class beside them. Texts that are
null or have no word have an empty set, link with nothing, and are their own component. Repeated rows are rows of one
class. A null doc_id is never the smallest one unless all others are null too. Empty tables give empty results; columns
other than id and text may have any names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bitmaps, bits_for, cut, done, drop_rows, lean, small, table, with_maybe
from .components import components
from .langid import chunks

WORDS, PERCENT, GROUPS, FINE, COARSE, MARKS, BUCKETS = 4, 85, 128, 512, 32, 8, 1 << 18
LEAF, SPLIT, CHUNK, LONG = 32, 1_024, 1_000_000, 512
#: Points, texts, and bytes of sets that a task holds at once, and how often a shingle must occur to be dealt to several
#: tasks.
TREE_ROWS, BLOCK_ROWS, BLOCK_BYTES, HOT = 32_768, 4_096, 6 << 20, 1_000_000

_M = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * _M
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, one text after another, and how many words come before each text and in all. A word is
    mixed into its length by blocks of eight bytes."""
    raw = [(t or "").encode() for t in texts]
    lengths = np.array([len(r) for r in raw], np.int64)
    data = _LOW[np.frombuffer(b"".join([*raw, bytes(8)]), np.uint8)]
    n, ends = len(data) - 8, np.cumsum(lengths)
    filled = ~_SPACE[data[:n]]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = ~filled[:-1], ~filled[1:]
    some = lengths > 0
    before[(ends - lengths)[some]] = True
    after[ends[some] - 1] = True
    first, last = np.flatnonzero(filled & before), np.flatnonzero(filled & after)
    size = last - first + 1
    eight = np.lib.stride_tricks.as_strided(data[:8].view("<u8"), (n + 1,), (1,))  # the eight bytes from each place on
    h, at = mixed(size.astype(np.uint64) * _M), np.arange(len(first))
    done = 0
    while len(at):
        block = eight[first[at] + done]
        rest = size[at] - done
        part = rest < 8
        block[part] &= (np.uint64(1) << (8 * rest[part]).astype(np.uint64)) - np.uint64(1)
        h[at] = mixed(h[at] ^ block)
        done += 8
        at = at[rest > 8]
    return h, np.searchsorted(first, np.concatenate([[0], ends]))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    word, upto = word_hashes(texts)
    places, full = _places(words), np.zeros(0, np.uint64)
    if len(word) >= words:
        full = word[: len(word) - words + 1] * places[0]
        for k in range(1, words):
            full += word[k : len(word) - words + 1 + k] * places[k]
        full = mixed(full)
    out = []
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
        if b - a >= words:
            s = np.sort(full[a : b - words + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(mixed(np.array([(word[a:b] * places[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@functools.lru_cache(8)
def _places(words: int) -> np.ndarray:
    return np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(words)], np.uint64)


def marks(s: np.ndarray) -> np.ndarray:
    """The least hash in each of MARKS ranges, 0 where there is none."""
    h = np.sort(mixed(s ^ _M))
    at = np.searchsorted(h, np.arange(MARKS, dtype=np.uint64) << np.uint64(61))
    out = np.append(h, np.uint64(0))[at]
    return np.where(out >> np.uint64(61) == np.arange(MARKS, dtype=np.uint64), out, np.uint64(0))


def point(s: np.ndarray, groups: int) -> np.ndarray:
    """Counts by group, a power of two of them."""
    return np.bincount((s >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=groups)


def groups_for(n: int) -> int:
    """GROUPS, or for sets of 1,024 shingles and more the power of two from their number on."""
    return GROUPS if n < 1024 else 1 << (n - 1).bit_length()


def packed(s: np.ndarray) -> bytes:
    """A point with one, two or four bytes for a count, as its largest one needs."""
    p = point(s, groups_for(len(s)))
    return p.astype(np.min_scalar_type(int(p.max()))).tobytes()


def folded(p: np.ndarray, groups: int) -> np.ndarray:
    """The same counts by fewer groups."""
    return p if len(p) == groups else p.reshape(groups, -1).sum(1)


def key_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def half(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def text_hash(text: str) -> F.Column:
    """128 bits."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def scan(docs: DataFrame, doc_id: str, text: str, words: int = WORDS, percent: int = PERCENT, long: int = LONG) -> DataFrame:
    """Rows (doc_id, th, n, k, key, mark, point), and at the end of each task rows (bucket, occurrences), in which parts of
    long sets count too."""
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *T._parse_datatype_string("th binary, n long, k long, key binary, mark long, point binary, bucket int, occurrences long").fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        names, arrow = schema.names, None
        for batch in lean(batches):
            arrow, done = batch.schema.field(0).type, 0
            for part in chunks(batch.column(2), CHUNK):
                sets = shingle_sets(part.to_pylist(), words)
                counts += np.bincount((np.concatenate([*sets, *(parts_of(s, long, percent) for s in sets if len(s) >= long)]) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                keys = [key_of(s) if len(s) else None for s in sets]
                m = len(sets)
                columns = [batch.column(0).slice(done, m), batch.column(1).slice(done, m), pa.array([len(s) for s in sets], pa.int64())]
                columns += [pa.array([half(key) if key else None for key in keys], pa.int64()), pa.array(keys, pa.binary())]
                columns += [pa.array([int(mixed(s ^ _M).min() >> np.uint64(1)) if len(s) else None for s in sets], pa.int64()), pa.array([packed(s) if len(s) else None for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64())], names)
                done += m
        if arrow is not None:
            at = np.flatnonzero(counts)
            m = len(at)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, arrow), *(pa.nulls(m, t) for t in (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())), pa.array(at.astype(np.int32)), pa.array(counts[at])], names)

    return docs.select(F.col(doc_id), text_hash(text).alias("th"), F.col(text)).mapInArrow(rows, schema)


def rarest(s: np.ndarray, often: np.ndarray, percent: int) -> np.ndarray:
    """Enough of a set's rarest shingles that linked sets share one."""
    take = len(s) - (percent * len(s) + 99) // 100 + 1
    order = (often[(s & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(24)) | (s >> np.uint64(40))
    return s[order <= np.partition(order, take - 1)[take - 1]]


@functools.lru_cache(8)
def intervals(long: int, percent: int) -> np.ndarray:
    """Sizes from which the intervals of long sets begin. Sets that link are in the same interval or in adjacent ones."""
    edges = [long]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] * 100 // percent + 1)
    return np.array(edges, np.int64)


def may_differ(label: int, long: int, percent: int) -> int:
    """In how many members linked sets of the intervals label and label + 1 can differ at most."""
    return 2 * (int(intervals(long, percent)[label + 2]) - 1) * (100 - percent) // (100 + percent)


@functools.lru_cache(256)
def _parts(label: int, long: int, percent: int) -> tuple[int, np.ndarray, np.ndarray]:
    """In how many shingles linked sets of the intervals label and label + 1 can differ at most, where in the range of
    hashes each of a few more parts than that begins, and the parts' names."""
    edges = intervals(long, percent)
    differ = may_differ(label, long, percent)
    m, most = differ + 1, differ + 1 + max(2, differ // 2)
    while m < most and m * np.exp(-edges[label] / m) + 6 * (m * np.exp(-edges[label] / m)) ** 0.5 + 2 > m - differ:  # parts that are empty by chance
        m += max(1, differ // 100)
    return differ, np.arange(m, dtype=np.uint64) * np.uint64((1 << 64) // m), mixed(np.arange(m, dtype=np.uint64) + np.uint64(label + 1 << 40))


def parts_of(s: np.ndarray, long: int, percent: int) -> np.ndarray:
    """The parts of a set of at least long shingles, hashed, for the pairs of intervals that it belongs to; the first
    interval has its pair with shorter sets by their rarest shingles. Empty parts count only if there are so many of them
    that no other part need be the same in a linked set."""
    at = int(np.searchsorted(intervals(long, percent), len(s), side="right")) - 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(s ^ _M))])
    out = [np.zeros(0, np.uint64)]
    for label in range(max(0, at - 1), at + 1):
        differ, edges, names = _parts(label, long, percent)
        begin = np.searchsorted(s, edges)
        end = np.append(begin[1:], len(s))
        keys, some = mixed((sums[end] - sums[begin]) ^ names), end > begin
        out.append(keys[some] if len(some) - some.sum() < len(some) - differ else keys)
    return np.concatenate(out)


def tokens_of(s: np.ndarray, often: np.ndarray, long: int, percent: int) -> np.ndarray:
    short = len(s) < intervals(long, percent)[1]
    return np.concatenate([rarest(s, often, percent) if short else s[:0], parts_of(s, long, percent) if len(s) >= long else s[:0]])


def entries(docs: DataFrame, text: str, seen: np.ndarray, words: int = WORDS, percent: int = PERCENT, most: int = HOT, long: int = LONG) -> DataFrame:
    """(token, salt, k) for the tokens of each class. k is half of the class's key. A class met again in the same task is
    left out. Tokens whose counter is over `most` are salted."""
    shared = docs.sparkSession.sparkContext.broadcast(seen)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        hot = max(most, 4 * int(often.mean()))
        met: set[bytes] = set()
        for batch in lean(batches):
            for part in chunks(batch.column(0), CHUNK):
                tokens, keys = [np.zeros(0, np.uint64)], []
                for s in shingle_sets(part.to_pylist(), words):
                    if not len(s) or (key := key_of(s)) in met:
                        continue
                    if len(met) < 100_000:
                        met.add(key)
                    tokens.append(tokens_of(s, often, long, percent))
                    keys.append(half(key))
                flat = np.concatenate(tokens)
                k = np.repeat(np.array(keys, np.int64), [len(t) for t in tokens[1:]])
                parts = often[(flat & np.uint64(BUCKETS - 1)).astype(np.int64)] // hot + 1
                salt = np.where(parts > 1, 1 + mixed(k.view(np.uint64)).astype(np.int64) % parts, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(salt), pa.array(k)], ["token", "salt", "k"])

    return docs.select(text).mapInArrow(rows, "token long, salt int, k long")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (token, salt, k) in this order, (g, k) of those whose token has several k or a salt: g, the group's name,
    is the token's least k, or for salted tokens, which many tasks see, a number made of the token. The last row of a
    batch waits for the next one, with the first k of its run and whether the run has had another."""
    held = None

    def told(t: np.ndarray, s: np.ndarray, k: np.ndarray, head: int | None, many: bool, last: bool) -> tuple[pa.RecordBatch, tuple]:
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1]) | (k[1:] != k[:-1])
        t, s, k = t[new], s[new], k[new]
        begins = np.ones(len(t), bool)
        begins[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
        run = np.cumsum(begins) - 1
        heads = k[begins].copy()
        if head is not None:
            heads[0] = head
        several = np.bincount(run) > 1
        several[0] |= many
        keep = (several[run]) | (s > 0)
        end = len(t) if last else len(t) - 1
        if not last:  # the last row's own run may go on
            keep[end] = False
        g = np.where(s > 0, mixed(t.view(np.uint64)).view(np.int64), heads[run])
        keep[end:] = False
        out = pa.RecordBatch.from_arrays([pa.array(g[keep]), pa.array(k[keep])], ["g", "k"])
        return out, (t[-1:], s[-1:], k[-1:], int(heads[-1]), bool(several[-1]))

    for batch in batches:
        t, s, k = (batch.column(i).to_numpy() for i in range(3))
        if not len(t):
            continue
        head, many = None, False
        if held is not None:
            t, s, k = (np.concatenate([h, x]) for h, x in zip(held[:3], (t, s, k), strict=True))
            head, many = held[3:]
        out, held = told(t, s, k, head, many, False)
        yield out
    if held is not None:
        yield told(*held, True)[0]


def needed(n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Overlap from which sets of these sizes link: overlap >= percent / (100 + percent) * (n + m), rounded up."""
    return -(-percent * (n + m) // (100 + percent))


def bound(function: Callable, **numbers: int) -> Callable:
    """The function of batches with these arguments, under its own name."""

    @functools.wraps(function)
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return function(batches, **numbers)

    return of_batches


def bounded(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sums of coordinate minima of the rows of p with those of q."""
    return np.minimum(p, q).sum(-1, dtype=np.int64)


class Lot:
    """The classes of whole blocks, and pairs that join their components: verified on the sets, or without sets all that
    the bound allows."""

    def __init__(self, n: np.ndarray, points: np.ndarray, node: np.ndarray, root: np.ndarray, side: np.ndarray, sets: list[np.ndarray] | None = None, percent: int = PERCENT, fine: dict[int, np.ndarray] | None = None):
        self.fine = fine or {}  # points with more groups, of long sets
        self.n, self.points, self.node, self.side, self.sets, self.percent = n, points, node, side, sets, percent
        # sums of coordinates: a looser bound of a quarter of the work or less, which unlike points seldom pass
        self.coarse = self.folded(points, COARSE)
        _, self.label = np.unique(root, return_inverse=True)
        self.parent = list(range(int(self.label.max(initial=-1)) + 1))
        self.ids: dict[int, np.ndarray] = {}
        self.links: list[tuple[int, int]] = []
        self.verified, self.told = 0, -1

    @classmethod
    def of_sets(cls, sets: list[np.ndarray], node: np.ndarray, root: np.ndarray, side: np.ndarray, percent: int = PERCENT) -> Lot:
        n = np.array([len(s) for s in sets], np.int64)
        kind = np.min_scalar_type(int(n.max(initial=0)))
        return cls(n, np.stack([point(s, FINE).astype(kind) for s in sets]), node, root, side, sets, percent)

    @staticmethod
    def folded(points: np.ndarray, groups: int) -> np.ndarray:
        sums = points.reshape(len(points), groups, -1).sum(-1, dtype=np.int64)
        return sums.astype(np.min_scalar_type(int(sums.max(initial=0))))

    def component(self) -> np.ndarray:
        if self.told != len(self.links):  # made anew only after a link
            p = np.array(self.parent)
            while (p[p] != p).any():
                p = p[p]
            self.components, self.told = p[self.label], len(self.links)
        return self.components

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def overlap(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of the sets of rows x and y, by marking the members of one set at a time."""
        self.verified += len(x)
        if not self.ids:
            return np.array([len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) for i, j in zip(x.tolist(), y.tolist(), strict=True)], np.int64)
        if len(np.unique(y)) < len(np.unique(x)):
            x, y = y, x
        order = np.argsort(x, kind="stable")
        edges = np.flatnonzero(np.diff(x[order], prepend=-1, append=-1))
        out = np.zeros(len(x), np.int64)
        mark = np.zeros(self.distinct, np.uint8)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            mine = self.ids[int(x[order[a]])]
            mark[mine] = 1
            for c in range(a, b, 2048):
                partners = order[c : min(b, c + 2048)]
                others = [self.ids[j] for j in y[partners].tolist()]
                out[partners] = np.add.reduceat(mark[np.concatenate(others)], np.cumsum([0, *map(len, others[:-1])]), dtype=np.int64)
            mark[mine] = 0
        return out

    def verify(self, x: np.ndarray, y: np.ndarray) -> bool:
        """Adds the links among these pairs that join components; whether there were any."""
        ok = np.ones(len(x), bool)
        if self.sets is not None:
            both = self.overlap(x, y)
            ok = 100 * both >= self.percent * (self.n[x] + self.n[y] - both)
        before = len(self.links)
        for i, j in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
            a, b = self.find(self.label[i]), self.find(self.label[j])
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                self.links.append((i, j))
        return len(self.links) > before

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        """Verifies pairs that the bound allows: the best one for each two components as long as that joins some, then
        all that are left."""
        least = needed(self.n[x], self.n[y], self.percent)
        ok = bounded(self.coarse[x], self.coarse[y]) >= least
        x, y, least = x[ok], y[ok], least[ok]
        near = bounded(self.points[x], self.points[y])
        ok = near >= least
        if self.fine:
            for k in np.flatnonzero(ok).tolist():
                p, q = self.fine.get(int(x[k])), self.fine.get(int(y[k]))
                if p is not None and q is not None:
                    g = min(len(p), len(q))
                    ok[k] = np.minimum(folded(p, g), folded(q, g)).sum(dtype=np.int64) >= least[k]
        x, y, near = x[ok], y[ok], near[ok]
        going = True
        while len(x):
            c = self.component()
            a, b = np.minimum(c[x], c[y]), np.maximum(c[x], c[y])
            order = np.lexsort((-near / (self.n[x] + self.n[y]), b, a))
            order = order[a[order] != b[order]]
            if not len(order):
                return
            if not going or len(order) < 64:
                self.verify(x[order], y[order])
                return
            best = np.ones(len(order), bool)
            best[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
            going = self.verify(x[order[best]], y[order[best]])
            x, y, near = (z[order[~best]] for z in (x, y, near))

    def fits(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of two sides whose sizes allow a link."""
        ok = (self.percent * np.maximum(self.n[x], self.n[y]) <= 100 * np.minimum(self.n[x], self.n[y])) & ((self.side[x] == 2) | (self.side[x] != self.side[y]))
        return x[ok], y[ok]

    def small_blocks(self, rows: np.ndarray, place: np.ndarray) -> None:
        """Blocks of at most LEAF rows, all at once: each row with those before it in its block."""
        for lag in range(1, LEAF):
            i = rows[place >= lag]
            if not len(i):
                return
            self.join(*self.fits(i, i - lag))

    def large_block(self, rows: np.ndarray, mark: np.ndarray | None = None) -> None:
        """A block by neighbours in orders by least hashes (one of them is given where there are no sets), then by its
        R-tree."""
        if self.sets is not None:
            flat, index = np.unique(np.concatenate([self.sets[r] for r in rows]), return_inverse=True)
            self.distinct = len(flat)
            self.ids = dict(zip(rows.tolist(), np.split(index.astype(np.int32), np.cumsum(self.n[rows])[:-1]), strict=True))
            least = np.stack([marks(self.sets[r]) for r in rows])
        else:
            least = mark[rows, None]
        for k in range(least.shape[1]):
            order = np.lexsort((self.n[rows], least[:, k]))
            same = least[order[1:], k] == least[order[:-1], k]
            self.join(*self.fits(rows[order[:-1][same]], rows[order[1:][same]]))
        if len(rows) > SPLIT:
            self.like(rows)
        else:
            self.tree(rows)
        self.ids = {}

    def like(self, rows: np.ndarray) -> None:
        """What tree() joins, for many rows. Points that the bound allows differ by no more than sets that link, so of more
        ranges of coordinates than that one at least is the same in both: only rows alike in a range meet in a tree. Sizes
        go by intervals, each with the next one; a pair of intervals with about as many differences as coordinates has one
        tree."""
        label = np.searchsorted(intervals(1, self.percent), self.n[rows], side="right") - 1
        for least in np.unique(np.concatenate([label, label - 1])).tolist():
            some = rows[(label == least) | (label == least + 1)]
            differ = may_differ(max(least, 0), 1, self.percent)
            if len(some) <= SPLIT or 2 * differ >= self.points.shape[1]:
                self.tree(some)
                continue
            edges = np.linspace(0, self.points.shape[1], differ + 2).astype(np.int64)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                names = mixed(np.arange(a, b, dtype=np.uint64) + np.uint64(1))
                alike = (self.points[some, a:b].astype(np.uint64) * names).sum(1, dtype=np.uint64)
                order = np.argsort(alike, kind="stable")
                mine, alike = some[order], alike[order]
                begins = np.flatnonzero(np.append(True, alike[1:] != alike[:-1]))
                sizes = np.diff(np.append(begins, len(mine)))
                few = np.repeat(sizes <= LEAF, sizes)
                for lag in range(1, LEAF):
                    at = np.flatnonzero(few[lag:] & (alike[lag:] == alike[:-lag]))
                    if not len(at):
                        break
                    for k in range(0, len(at), 16_384):
                        self.join(*self.apart(*self.fits(mine[at[k : k + 16_384] + lag], mine[at[k : k + 16_384]])))
                for begin, size in zip(begins[sizes > LEAF].tolist(), sizes[sizes > LEAF].tolist(), strict=True):
                    self.tree(mine[begin : begin + size])

    def apart(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of two components."""
        c = self.component()
        ok = c[x] != c[y]
        return x[ok], y[ok]

    def tree(self, rows: np.ndarray) -> None:
        """Rows are packed into leaves by size and leading counts; leaves, then upper boxes, have the maxima of their
        points as corner. Boxes are joined with boxes from the top."""
        rows = rows[np.lexsort((self.points[rows, 1], self.points[rows, 0] // 4, self.n[rows]))]
        leaves = np.arange(0, len(rows), LEAF)
        n, p, c = self.n[rows], self.points[rows], self.component()[rows]
        if c.min() == c.max():
            return
        levels = [(n, n, p, c, c)]
        while len(levels[-1][0]) > 1:
            lo, hi, top, c, d = levels[-1]
            at = np.arange(0, len(lo), LEAF if len(levels) == 1 else 8)
            levels.append((np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(top, at), np.minimum.reduceat(c, at), np.maximum.reduceat(d, at)))

        def descend(a: np.ndarray, b: np.ndarray, level: int) -> None:
            """Pairs of boxes of a level, a <= b, a bounded number at once."""
            fan = LEAF if level == 1 else 8
            lo, hi, top, c, d = levels[level - 1]
            for i in range(0, len(a), max(1, 100_000 // (fan * fan))):
                some = slice(i, i + max(1, 100_000 // (fan * fan)))
                if level == 1:  # leaves whose rows have come to be in one component
                    now = self.component()[rows]
                    least, most = np.minimum.reduceat(now, leaves), np.maximum.reduceat(now, leaves)
                    some = np.arange(len(a))[some]
                    some = some[(least[a[some]] != most[b[some]]) | (least[b[some]] != most[a[some]])]
                x = (a[some, None, None] * fan + np.arange(fan)[None, :, None]).repeat(fan, 2).ravel()
                y = (b[some, None, None] * fan + np.arange(fan)[None, None, :]).repeat(fan, 1).ravel()
                ok = (x < len(lo)) & (y < len(lo)) & (x < y if level == 1 else x <= y)
                x, y = x[ok], y[ok]
                ok = (self.percent * lo[y] <= 100 * hi[x]) & ((c[x] != d[y]) | (c[y] != d[x]))
                x, y = x[ok], y[ok]
                if level == 1:
                    ok = now[x] != now[y]
                    x, y = self.fits(rows[x[ok]], rows[y[ok]])
                    for j in range(0, len(x), 16_384):
                        self.join(x[j : j + 16_384], y[j : j + 16_384])
                    continue
                near = [bounded(top[x[j : j + 16_384]], top[y[j : j + 16_384]]) for j in range(0, len(x), 16_384)]
                ok = np.concatenate([*near, np.zeros(0, np.int64)]) >= needed(lo[x], lo[y], self.percent)
                if ok.any():
                    descend(x[ok], y[ok], level - 1)

        if len(levels) > 1:
            descend(np.zeros(1, np.int64), np.zeros(1, np.int64), len(levels) - 1)

    def pairs(self) -> pa.RecordBatch:
        at = np.array(self.links, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(self.node[at[:, k]]) for k in (0, 1)], ["a", "b"])


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Batches cut at changes of the first columns: each has whole runs only. A run is held whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(k).to_numpy() for k in range(keys)])
        change = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1
        if held and (tuple(held[-1].column(k)[-1].as_py() for k in range(keys)) != tuple(int(v) for v in ids[:, 0])):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        if len(change):
            held.append(batch.slice(0, change[-1]))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = [batch.slice(change[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _blocks(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """A batch's whole blocks, in lots of about CHUNK of the rows' sizes, and where in each lot a block begins, with the
    end."""
    g, block = (batch.column(k).to_numpy() for k in (0, 1))
    edges = np.concatenate([[0], np.flatnonzero((g[1:] != g[:-1]) | (block[1:] != block[:-1])) + 1, [len(g)]])
    ends, upto = np.cumsum(sizes), 0
    while upto < len(edges) - 1:
        begin = upto
        upto = max(begin + 1, int(np.searchsorted(ends[edges[1:] - 1], (ends[edges[begin] - 1] if begin else 0) + CHUNK, side="right")))
        yield batch.slice(edges[begin], edges[upto] - edges[begin]), edges[begin : upto + 1] - edges[begin]


def _solved(lot: Lot, edges: np.ndarray, mark: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    sizes = np.diff(edges)
    place = np.arange(edges[-1]) - np.repeat(edges[:-1], sizes)
    few = np.flatnonzero(np.repeat(sizes, sizes) <= LEAF)
    lot.small_blocks(few, place[few])
    for a, b in zip(edges[:-1][sizes > LEAF], edges[1:][sizes > LEAF], strict=True):
        lot.large_block(np.arange(a, b), mark)
    if lot.links:
        yield lot.pairs()


def _near(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (g, block, side, node, root, n, mark, point), ordered by g and block: a forest of pairs (a, b) that the bound
    allows, between classes with different roots. Rows of side 2 are joined with each other, those of sides 0 and 1 with
    the other side."""
    for whole in lean(runs(batches, 2)):
        lengths = pc.binary_length(whole.column(7)).to_numpy(zero_copy_only=False).astype(np.int64)
        for batch, edges in _blocks(whole, lengths):
            side, node, root, n, mark = (batch.column(k).to_numpy() for k in range(2, 7))
            raw = batch.column(7).to_pylist()
            groups = [groups_for(k) for k in n.tolist()]
            full = [np.frombuffer(r, f"u{len(r) // g}") for r, g in zip(raw, groups, strict=True)]
            points = np.stack([folded(p, GROUPS) for p in full])
            points = points.astype(np.min_scalar_type(int(points.max())))
            yield from _solved(Lot(n, points, node, root, side, None, percent, {k: p for k, p in enumerate(full) if len(p) > GROUPS}), edges, mark)


def _linked(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (g, block, side, node, root, text) likewise: a forest of verified links (a, b)."""
    for whole in lean(runs(batches, 2)):
        lengths = pc.fill_null(pc.binary_length(whole.column(5)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for batch, edges in _blocks(whole, lengths):
            side, node, root = (batch.column(k).to_numpy() for k in range(2, 5))
            sets = [s for part in chunks(batch.column(5), CHUNK) for s in shingle_sets(part.to_pylist(), words)]
            yield from _solved(Lot.of_sets(sets, node, root, side, percent), edges)


def forest(members: DataFrame, most: int, solve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (a, b) that join the classes of each group as far as solve joins any two. members has g, node, size (bytes)
    and more columns; solve gets rows (g, block, side, node, root, ...) and gives pairs of classes of one block that join
    all that it would join there. A block has about `most` rows or BLOCK_BYTES."""
    sizes = members.groupBy("g").agg(F.count(F.lit(1)).alias("_rows"), F.sum("size").alias("_n"))
    parts = F.ceil(F.greatest(F.col("_rows") / most, F.col("_n") / BLOCK_BYTES)).cast("long")
    large = cut(sizes.select("g", parts.alias("_parts")).filter("_parts > 1"))
    dealt = members.join(small(large), "g", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)).cast("long"))
    first, second = (F.pmod(F.xxhash64(F.lit(seed), "node"), F.col("_parts")) for seed in (1, 2))
    block = F.explode(F.when(F.col("_parts") > 1, F.array(first, F.col("_parts") + second)).otherwise(F.array(F.lit(0).cast("long"))))
    more = [c for c in members.columns if c not in ("g", "node", "size")]
    pairs = solve(dealt.select("g", block.alias("block"), F.lit(2).alias("side"), "node", F.col("node").alias("root"), *more))
    if large.isEmpty():
        return pairs
    labelled = members.join(small(large), "g").join(components(pairs), "node", "left")
    labelled = cut(labelled.withColumn("root", F.coalesce("root", "node")))
    by_root = labelled.groupBy("g", "root").agg(F.count(F.lit(1)).alias("_rows"), F.sum("size").alias("_n"))
    main = by_root.groupBy("g").agg(F.max(F.struct("_rows", "_n", "root")).alias("_m"), F.sum("_rows").alias("_all"), F.sum("_n").alias("_size"))
    left, left_size = F.col("_all") - F.col("_m._rows"), F.col("_size") - F.col("_m._n")
    main = cut(main.filter(left > 0).select("g", F.col("_m.root").alias("_main"), F.ceil(F.greatest(left / most, left_size / BLOCK_BYTES)).cast("long").alias("_others")))
    every = labelled.join(small(main), "g")
    p, q, zero = F.pmod(F.xxhash64("node"), F.col("_parts")), F.pmod(F.xxhash64(F.lit(3), "node"), F.col("_others")), F.lit(0).cast("long")
    columns = ["g", "block", "side", "node", "root", *more]
    whole = every.withColumn("_q", F.explode(F.sequence(zero, F.col("_others") - 1))).select("*", (p * F.col("_others") + F.col("_q")).alias("block"), F.lit(0).alias("side"))
    others = every.filter("root <> _main").withColumn("_p", F.explode(F.sequence(zero, F.col("_parts") - 1))).select("*", (F.col("_p") * F.col("_others") + q).alias("block"), F.lit(1).alias("side"))
    return pairs.union(solve(whole.select(*columns).union(others.select(*columns))))


def in_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.col("g"), F.col("block")).sortWithinPartitions("g", "block", "side", "node")


def with_texts(blocks: DataFrame, docs: DataFrame, doc_id: str, text: str, twice: DataFrame) -> DataFrame:
    """blocks (g, block, side, node, root, th, id) with the whole text of a row that has that hash and id; twice has the
    (th, id) of more rows than one, whose text is sent once. Where blocks aren't few, only documents that a filter of
    their hashes lets through are shuffled."""
    blocks = cut(blocks)
    given = docs.select(text_hash(text).alias("_th"), F.col(doc_id).alias("_of"), F.col(text).alias("text"))
    if small(blocks) is blocks:
        bits = bits_for(blocks.count())
        given = with_maybe(given, cut(bitmaps(blocks, "th", bits=bits)), "_maybe", "_th", bits=bits).filter("_maybe").drop("_maybe")
    columns = ["g", "block", "side", "node", "root", "text"]

    def told(some: DataFrame) -> DataFrame:
        return given.join(small(some), (F.col("_th") == F.col("th")) & F.col("_of").eqNullSafe(F.col("id"))).select(*columns)

    if twice.isEmpty():
        return told(blocks)
    near, same = small(twice.toDF("_t", "_i")), (F.col("th") == F.col("_t")) & F.col("id").eqNullSafe(F.col("_i"))
    repeated, rest = cut(blocks.join(near, same, "left_semi")), cut(blocks.join(near, same, "left_anti"))
    return told(rest).union(told(repeated).dropDuplicates(columns[:4]))


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row for each document: doc_id, th (hash of its text), n_shingles, class (null without shingles), and root (the
    least class of its component)."""
    scanned = cut(scan(docs, doc_id, text, words, percent, LONG).withColumn("row", F.monotonically_increasing_id()))
    rows = scanned.filter("bucket is null")
    counters = np.zeros(BUCKETS, np.int64)
    for r in scanned.filter("bucket is not null").groupBy("bucket").agg(F.sum("occurrences").alias("m")).collect():  # BUCKETS rows at most
        counters[r["bucket"]] = r["m"]
    twice = cut(rows.groupBy("th", "doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("th", "doc_id"))
    heads = rows.filter("key is not null").groupBy("key").agg(F.min(F.struct("row", "k", "th", "doc_id", "n", "mark", "point")).alias("_h"))
    classes = cut(heads.select("key", F.col("_h.row").alias("node"), "_h.k", "_h.th", F.col("_h.doc_id").alias("id"), "_h.n", "_h.mark", "_h.point"))
    dealt = entries(docs, text, counters, words, percent, HOT, LONG).repartition(F.col("token"), F.col("salt")).sortWithinPartitions("token", "salt", "k")
    grouped = cut(dealt.mapInArrow(_grouped, "g long, k long").distinct())
    pointed = classes.select("k", "node", "n", "mark", "point", F.octet_length("point").cast("long").alias("size"))
    members = cut(grouped.join(pointed, "k").drop("k"))
    near = forest(members, TREE_ROWS, lambda b: cut(in_blocks(b).mapInArrow(bound(_near, percent=percent), "a long, b long")))
    done(grouped, members)
    of = components(near)
    groups = of.select(F.col("root").alias("g"), "node").union(of.select("root", "root").distinct())
    close = cut(groups.join(classes.select("node", "th", "id", (F.col("n") * 8).alias("size")), "node"))
    verify = bound(_linked, words=words, percent=percent)
    links = forest(close, BLOCK_ROWS, lambda b: cut(in_blocks(with_texts(b, docs, doc_id, text, twice)).mapInArrow(verify, "a long, b long")))
    labels = cut(classes.select("key", "node").join(components(links), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    return rows.join(small(labels), "key", "left").select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("node").alias("class"), "root")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row for each document: doc_id, th, n_shingles, component_id (the smallest doc_id that links reach)."""
    found = cut(jaccard_classes(docs, doc_id, text, words, percent))
    least = cut(found.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("_least")))
    out = found.join(small(least), "root", "left")
    return out.select("doc_id", "th", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"))


def drop_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, that with the smallest doc_id; rows with an empty set all stay."""
    found = cut(jaccard_classes(docs, doc_id, text, words, percent).filter("root is not null").select("root", "doc_id", "th"))
    who = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "th")
    best = cut(found.groupBy("root").agg(F.min(who).alias("_best"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    rows = found.join(small(best), "root").withColumn("_stays", F.col("doc_id").eqNullSafe(F.col("_best.id")) & (F.col("th") == F.col("_best.th")))
    rows = cut(rows.select(F.col("th").alias("_key"), F.col("doc_id").alias("_id"), "_stays"))
    lost = rows.filter("not _stays").select("_key", "_id").distinct()
    twice = rows.filter("_stays").groupBy("_key", "_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_key", "_id")
    return drop_rows(docs, text_hash(text), doc_id, lost, twice)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of documents."""
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
