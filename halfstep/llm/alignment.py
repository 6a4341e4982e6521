"""Cross-tokenizer alignment, each distinct text once.

Documents are shuffled by their full text and counted there; a text is encoded by both tokenizers and aligned once, however
many documents have it. Tokens are laid over the bytes of space + text, and byte offsets where tokens of both end cut them
into groups; each token of A in a group links with each of B in it. How many documents hold a pair of ids linked is the sum,
over the distinct texts that do, of the number of documents with that text. Measures go back to the documents by the
SHA-256 of their text.

A worker keeps the alignments of segments, a space and what follows up to the next one after something other than white
space, as neither tokenizer has tokens that go on over such a place (that is read from the tokenizers' files; with others
a text is one segment). A text of which a segment's tokens don't give its bytes is encoded and compared whole.

Counts of pairs are looked up in two tiers. The pairs of the largest counts, at most HEAD of them, are broadcast, so no pair
that very many texts hold is shuffled; the others are joined by shuffle. Largest counts by id of A are as many as its
vocabulary has entries.

Texts that are null or empty, or whose tokens of A or B don't give back the bytes of space + text (as with U+2581), have no
tokens: zeros, and '' as digest. Repeated rows count as documents of their own. Empty tables give empty results; columns
other than id and text may have any names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, done, lean, small, table
from .langid import chunks

#: Pairs of the first tier; segments of a text handled at once; characters of segments that are encoded side by side;
#: segments that a worker knows before it forgets all; pairs that a task sums before it hands them on.
HEAD, LOT, KEPT_CHARS, SEGMENTS, PAIRS = 1 << 20, 50_000, 64, 200_000, 1 << 20
#: Characters after which a space doesn't begin a segment.
SPACES = frozenset(c for c in map(chr, range(0x3001)) if c.isspace() or c == "\u180e")
#: A space and what follows, up to the next space that comes after something other than white space.
SEGMENT = re.compile(r" [^ ]*(?:(?<=[\s᠎]) [^ ]*)*")

NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
MEASURES = f"key binary, copies long, {', '.join(f'{n} long' for n in NUMBERS)}, groups binary, a array<int>, b array<int>, times array<int>"


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others, in
    order, for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}


class Aligner:
    """Both tokenizers and the alignments of the segments met so far."""

    def __init__(self, first: str, second: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(first)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=second)
        values = byte_values()
        self.a_bytes = {i: bytes(map(values.__getitem__, t)) if all(c in values for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        spec = json.loads(first)
        own_pattern = spec.get("normalizer") is None and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and spec["pre_tokenizer"].get("use_regex", True)
        self.in_segments = own_pattern and not any("▁" in p.lstrip("▁") for p in pieces)
        self.a_length = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_length[list(self.a_bytes)] = list(map(len, self.a_bytes.values()))
        self.b_length = np.array(list(map(len, self.b_bytes)), np.int64)
        self.a_text, self.b_text = list(map(str, range(len(self.a_length)))), list(map(str, range(len(pieces))))
        self.reset()

    def reset(self) -> None:
        """No segment is known: place tells a segment's number, -1 if a tokenizer doesn't give back its bytes."""
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        self.numbers = [np.zeros(0, np.int64)] * 4
        self.codes, self.starts = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def encoded(self, segments: list[str]) -> list[tuple[list[int], list[int], bool]]:
        """Ids of A and B of strings that begin with a space, and whether both give back the bytes."""
        a = [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]
        b = self.b.encode([s[1:] for s in segments], num_threads=1)
        out = []
        for s, x, y in zip(segments, a, b, strict=True):
            raw = s.encode()
            out.append((x, y, b"".join(map(self.a_bytes.__getitem__, x)) == raw == b"".join(map(self.b_bytes.__getitem__, y))))
        return out

    def aligned(self, x: list[int], y: list[int]) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, n_links, the groups as text, and the pairs (a in the upper 32 bits) with how often they link."""
        groups, pairs, links = [], Counter(), 0
        i = j = at = to = begin_i = begin_j = 0
        while i < len(x) or j < len(y):
            if at <= to:
                at += len(self.a_bytes[x[i]])
                i += 1
            else:
                to += len(self.b_bytes[y[j]])
                j += 1
            if at == to:
                p, q = x[begin_i:i], y[begin_j:j]
                groups.append(",".join(map(str, p)) + "|" + ",".join(map(str, q)))
                links += len(p) * len(q)
                if len(p) == len(q) == 1:
                    pairs[p[0] << 32 | q[0]] += 1
                else:
                    q_times = Counter(q).items()
                    for u, m in Counter(p).items():
                        for v, n in q_times:
                            pairs[u << 32 | v] += m * n
                begin_i, begin_j = i, j
        codes = np.fromiter(pairs, np.int64, len(pairs))
        return len(x), len(y), len(groups), links, ";".join(groups), codes, np.fromiter(pairs.values(), np.int64, len(pairs))

    def learn(self, segments: Iterable[str]) -> None:
        """Aligns segments that aren't known. Short ones that end in something other than white space are encoded side by
        side, as one text."""
        joint, apart = [], []
        for s in dict.fromkeys(s for s in segments if s not in self.place):
            (joint if len(s) <= KEPT_CHARS and s[-1] not in SPACES else apart).append(s)
        if joint and not self._side_by_side(joint):
            apart += joint
        for k in range(0, len(apart), 256):
            some = apart[k : k + 256]
            new = [(s, self.aligned(x, y)) if ok else (s, None) for s, (x, y, ok) in zip(some, self.encoded(some), strict=True)]
            self.place |= {s: -1 for s, one in new if one is None}
            kept = [(s, one) for s, one in new if one is not None]
            if kept:
                codes = [np.repeat(one[5], one[6]) for _, one in kept]
                self._keep([s for s, _ in kept], [one[4] for _, one in kept], [np.array([one[m] for _, one in kept], np.int64) for m in range(4)], np.concatenate(codes), np.cumsum([len(c) for c in codes]))

    def _keep(self, segments: list[str], groups: list[str], numbers: list[np.ndarray], codes: np.ndarray, ends: np.ndarray) -> None:
        self.place.update(zip(segments, range(len(self.groups), len(self.groups) + len(segments)), strict=True))
        self.groups += groups
        self.numbers = [np.concatenate([x, y]) for x, y in zip(self.numbers, numbers, strict=True)]
        self.starts = np.concatenate([self.starts, ends + len(self.codes)])
        self.codes = np.concatenate([self.codes, codes])

    def _side_by_side(self, segments: list[str]) -> bool:
        """Aligns segments as one text; False if a tokenizer doesn't give back its bytes."""
        text = "".join(segments)
        raw = text.encode()
        a, b = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:])
        if not b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b)):
            return False
        x, y = np.array(a, np.int64), np.array(b, np.int64)
        to_x, to_y = np.cumsum(self.a_length[x]), np.cumsum(self.b_length[y])
        cuts = np.intersect1d(to_x, to_y, assume_unique=True)
        end_x, end_y = np.searchsorted(to_x, cuts, side="right"), np.searchsorted(to_y, cuts, side="right")
        of_x, of_y = np.diff(end_x, prepend=0), np.diff(end_y, prepend=0)
        ends = np.searchsorted(cuts, np.cumsum([len(s.encode()) for s in segments]), side="right")  # groups up to each segment's end
        first, second = [self.a_text[i] for i in a], [self.b_text[i] for i in b]
        groups, i, j = [], 0, 0
        for m, n in zip(end_x.tolist(), end_y.tolist(), strict=True):
            groups.append(f"{first[i]}|{second[j]}" if m - i == n - j == 1 else ",".join(first[i:m]) + "|" + ",".join(second[j:n]))
            i, j = m, n
        links = of_x * of_y
        of = np.repeat(np.arange(len(cuts)), links)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(links) - links, links)
        codes = x[(end_x - of_x)[of] + nth // of_y[of]] << 32 | y[(end_y - of_y)[of] + nth % of_y[of]]
        begins = [0, *ends[:-1].tolist()]
        total = [np.diff(np.concatenate([[0], np.cumsum(z)])[ends], prepend=0) for z in (of_x, of_y, np.ones(len(cuts), np.int64), links)]
        self._keep(segments, [";".join(groups[m:n]) for m, n in zip(begins, ends.tolist(), strict=True)], total, codes, np.cumsum(total[3]))
        return True

    def measured(self, texts: list[str]) -> list[tuple | None]:
        """Of each text n_a, n_b, n_groups, n_links, SHA-256 of the groups, distinct pairs and how often each links; None for
        texts without tokens."""
        cut_up = [SEGMENT.findall(f" {t}") if self.in_segments else [f" {t}"] for t in texts]
        if len(self.place) > SEGMENTS:
            self.reset()
        self.learn(s for segments in cut_up if len(segments) <= LOT for s in segments)
        out = [self._text(segments) if len(segments) <= LOT else None for segments in cut_up]
        return [self._text(segments) if len(segments) > LOT else known for segments, known in zip(cut_up, out, strict=True)]

    def _text(self, segments: list[str]) -> tuple | None:
        sums, sha, codes, times = np.zeros(4, np.int64), hashlib.sha256(), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for k in range(0, len(segments), LOT):
            some = segments[k : k + LOT]
            if len(segments) > LOT:  # a text so long is learned by lots
                if len(self.place) > SEGMENTS:
                    self.reset()
                self.learn(some)
            at = list(map(self.place.__getitem__, some))
            if -1 in at:
                whole = "".join(segments)
                ((x, y, ok),) = self.encoded([whole])
                if not ok:
                    return None
                *numbers, groups, codes, times = self.aligned(x, y)
                return *numbers, hashlib.sha256(groups.encode()).digest(), codes, times
            sha.update(((";" if k else "") + ";".join([self.groups[i] for i in at])).encode())
            i = np.array(at)
            sums += [n[i].sum() for n in self.numbers]
            sizes = self.starts[i + 1] - self.starts[i]
            new = self.codes[np.arange(sizes.sum()) + np.repeat(self.starts[i] - (np.cumsum(sizes) - sizes), sizes)]
            codes, times = summed(np.concatenate([codes, new]), np.concatenate([times, np.ones(len(new), np.int64)]))
        return *sums.tolist(), sha.digest(), codes, times


def summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sums of n by code."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    begins = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[begins], np.add.reduceat(n[order], begins) if len(codes) else n


_aligners: dict[int, tuple] = {}


def aligner(files: tuple[str, bytes]) -> Aligner:
    """Built once in each worker for a broadcast value."""
    if id(files) not in _aligners:
        _aligners.clear()
        _aligners[id(files)] = (files, Aligner(*files))
    return _aligners[id(files)][1]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int32)))


def alignments(docs: DataFrame, first: str, second: str, text: str = "text") -> DataFrame:
    """A row for each distinct text that has tokens: key (SHA-256 of the text), copies (rows with it), n_a, n_b, n_groups,
    n_links, groups (SHA-256 of their digest form), and the distinct linked pairs as arrays a, b, times."""
    with open(first, encoding="utf-8") as f, open(second, "rb") as g:
        files = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(files.value)
        for batch in lean(batches):
            at = 0
            for part in chunks(batch.column(2), 1_000_000):
                found = tool.measured(part.to_pylist())
                some, out = [at + k for k, m in enumerate(found) if m is not None], [m for m in found if m is not None]
                take = pa.array(some, pa.int64())
                columns = [batch.column(0).take(take), batch.column(1).take(take), *(pa.array([m[k] for m in out], pa.int64()) for k in range(4)), pa.array([m[4] for m in out], pa.binary())]
                columns += [_lists([m[5] >> 32 for m in out]), _lists([m[5] & 0xFFFFFFFF for m in out]), _lists([m[6] for m in out])]
                yield pa.RecordBatch.from_arrays(columns, ["key", "copies", *NUMBERS, "groups", "a", "b", "times"])
                at += len(part)

    texts = docs.select(F.col(text).alias("_t")).filter("_t is not null and _t <> ''").groupBy("_t").agg(F.count(F.lit(1)).alias("copies"))
    return texts.select(text_key(F.col("_t")).alias("key"), "copies", "_t").mapInArrow(rows, MEASURES)


def text_key(text: F.Column) -> F.Column:
    return F.unhex(F.sha2(text, 256))


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (copies, a, b), the sums of copies by pair as far as the task's memory for PAIRS of them goes."""
    codes, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((codes >> 32).astype(np.int32)), pa.array((codes & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], ["a", "b", "n"])

    for batch in lean(batches):
        for k in range(0, batch.num_rows, 512):
            some = batch.slice(k, 512)
            a, b = (some.column(c).flatten().to_numpy().astype(np.int64) for c in (1, 2))
            copies = np.repeat(some.column(0).to_numpy(), some.column(1).value_lengths().to_numpy())
            new, m = summed(a << 32 | b, copies)
            codes, n = summed(np.concatenate([codes, new]), np.concatenate([n, m]))
            if len(codes) > PAIRS:
                yield told()
                codes, n = codes[:0], n[:0]
    yield told()


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best): in how many documents each pair is linked, and whether no pair of its a is in more."""
    counts = cut(aligned.select("copies", "a", "b").mapInArrow(_pair_sums, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))
    most = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("most")))  # a row for each id of A at most
    return cut(counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")))


def first_tier(counts: DataFrame, most: int) -> int:
    """The least count from which on there are at most `most` pairs."""
    size = F.when(F.col("n") < 4096, F.col("n")).otherwise((F.log2("n") * 340).cast("long") + 65_536)  # finer than one in 400 above
    sizes = sorted(((r["s"], r["pairs"], r["low"]) for r in counts.groupBy(size.alias("s")).agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("low")).collect()), reverse=True)  # some 20,000 rows at most
    so_far, least = 0, (1 << 62)
    for _, pairs, low in sizes:
        so_far += pairs
        if so_far > most:
            break
        least = low
    return least


def scores(aligned: DataFrame, counts: DataFrame, head: int = HEAD) -> DataFrame:
    """(key, n_best, count_sum) of each distinct text."""
    spark = aligned.sparkSession
    least = first_tier(counts, head)
    top = counts.filter(F.col("n") >= least).select(F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long")).alias("code"), "n", "best").toArrow()  # head rows at most
    code, n, best = (top.column(k).to_numpy() for k in range(3))
    order = np.argsort(code)
    shared = spark.sparkContext.broadcast((code[order], n[order], best[order]))

    def parts(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        lengths = batch.column(1).value_lengths().to_numpy()
        a, b, times = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in (1, 2, 3))
        owner, codes = np.repeat(np.arange(batch.num_rows), lengths), a << 32 | b
        known, _, _ = shared.value
        at = np.searchsorted(known, codes)
        at[at == len(known)] = 0
        hit = known[at] == codes if len(known) else np.zeros(len(codes), bool)
        return owner, a, b, times, at, hit

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, n, best = shared.value
        for whole in lean(batches):
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                owner, _, _, times, at, hit = parts(batch)
                sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
                for out, value in zip(sums, (best, n), strict=True):
                    np.add.at(out, owner[hit], times[hit] * value[at[hit]])
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums)], ["key", "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in lean(batches):
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                owner, a, b, times, _, hit = parts(batch)
                rest = ~hit
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[rest])), pa.array(a[rest].astype(np.int32)), pa.array(b[rest].astype(np.int32)), pa.array(times[rest])], ["key", "a", "b", "times"])

    given = aligned.select("key", "a", "b", "times")
    known = given.mapInArrow(looked_up, "key binary, n_best long, count_sum long")
    second = counts.filter(F.col("n") < least)
    if second.isEmpty():
        return known
    rest = given.mapInArrow(others, "key binary, a int, b int, times long").join(second, ["a", "b"])
    rest = rest.select("key", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    return known.union(rest).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, first: str, second: str, doc_id: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. first is the file of
    tokenizer A (of the tokenizers library, byte-level), second that of B (sentencepiece)."""
    aligned = cut(alignments(docs, first, second, text))
    counts = pair_counts(aligned)
    found = cut(aligned.select("key", *NUMBERS, "groups").join(cut(scores(aligned, counts, head)), "key"))
    done(counts)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("_key"))
    out = rows.join(small(found.withColumnRenamed("key", "_key")), "_key", "left")
    numbers = (F.coalesce(F.col(n), F.lit(0).cast("long")).alias(n) for n in (*NUMBERS, "n_best", "count_sum"))
    return out.select("doc_id", *numbers, F.coalesce(F.lower(F.hex("groups")), F.lit("")).alias("groups_sha256"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of documents."""
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
