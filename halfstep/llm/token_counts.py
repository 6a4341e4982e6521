"""Token counts by a map-side lookup in two tiers.

A text is cut into pre-tokens by the tokenizer's pattern. The first tier is a table of the token counts of frequent
pre-tokens of at most 16 bytes, from a bounded sample of texts: a hash table in arrays, broadcast as it is (2.4 MB). The second
is each worker's cache: what the table lacks is encoded by the tokenizer's model and kept, up to CACHE bytes. Pre-tokens are never
shuffled: those of the sample are counted on the driver, to which at most SAMPLE_ROWS texts of SAMPLE_BYTES come. The
sample only affects speed: every pre-token of every whole text is counted.

The strings of special tokens count as one token each, as the tokenizers library takes them. Texts with characters from
U+0300 on are cut by the library, so that its version of Unicode holds. Null and empty texts have no tokens. Repeated rows
count alike, and an empty table gives an empty one; columns other than id and text may have any names.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table
from .langid import chunks

#: Pattern of the byte-level pre-tokenizer (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Different texts in the sample, and how long each may be; entries of the table; bytes of a cache.
SAMPLE_ROWS, SAMPLE_BYTES, FREQUENT, CACHE = 1_024, 65_536, 65_536, 32 << 20
#: Words that are looked up side by side.
SLICE = 65_536

#: Masks of the first 0 to 8 bytes of a number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Lengths:
    """The first tier: an open-addressing hash table in arrays of fixed width, 18 bytes a slot, with at least as many slots
    free as taken. Its keys are whole words of at most 16 bytes, as two numbers and their length, so what is found is exact."""

    def __init__(self, words: list[str], counts: bytes):
        first, second, size = self.keys(words)
        fit = np.flatnonzero((size > 0) & (size <= 16))
        slots = 1 << max(4, (2 * len(fit)).bit_length())
        self.first, self.second = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.size, self.count = np.zeros(slots, np.uint8), np.zeros(slots, np.uint8)
        at = self.places(first[fit], second[fit], size[fit])
        for k, slot in zip(fit.tolist(), at.tolist(), strict=True):
            while self.size[slot]:
                slot = (slot + 1) % slots
            self.first[slot], self.second[slot], self.size[slot], self.count[slot] = first[k], second[k], size[k], counts[k]

    @staticmethod
    def keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first and the next eight bytes of each word, and its length in bytes."""
        array = pa.array(words, pa.large_string())
        ends = np.frombuffer(array.buffers()[1] or bytes(8), np.int64)[: len(words) + 1]
        data = np.concatenate([np.frombuffer(array.buffers()[2] or b"", np.uint8)[: ends[-1]], np.zeros(16, np.uint8)])
        eight = np.lib.stride_tricks.as_strided(data[:8].view("<u8"), (len(data) - 7,), (1,))  # the eight bytes from each place on
        begin, size = ends[:-1], np.diff(ends)
        return eight[begin] & _FIRST[np.minimum(size, 8)], eight[begin + 8] & _FIRST[np.clip(size - 8, 0, 8)], size

    def places(self, first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
        h = (first ^ (second * np.uint64(0xD6E8FEB86659FD93)) ^ size.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(32))) & np.uint64(len(self.size) - 1)).astype(np.int64)

    def of(self, words: list[str]) -> np.ndarray:
        """The count of each word, -1 for those that the table lacks."""
        first, second, size = self.keys(words)
        out = np.full(len(words), -1, np.int64)
        left = np.flatnonzero(size <= 16)
        at = self.places(first[left], second[left], size[left])
        while len(left):
            there = self.size[at]
            same = (there == size[left]) & (self.first[at] == first[left]) & (self.second[at] == second[left])
            out[left[same]] = self.count[at[same]]
            on = ~same & (there > 0)
            left, at = left[on], (at[on] + 1) % len(self.size)
        return out


class TokenCounter:
    """Counts tokens of texts for one worker. The first tier is a table, or words separated by U+0000, which no frequent
    pre-token has, with a byte for each one's count; what it lacks is in the worker's cache."""

    def __init__(self, tokenizer: str, words: str | Lengths, counts: bytes = b""):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.tokenizer.encode_special_tokens = True  # pre-tokens hold no special token: texts are split at those before
        self.frequent = words if isinstance(words, Lengths) else Lengths(words.split("\0") if counts else [], counts)
        self.find, self.beyond = regex.compile(PATTERN).findall, regex.compile("[^\\x00-\\u02ff]").search
        self.cut_by_library = pre_tokenizers.Split(Regex(PATTERN), "isolated").pre_tokenize_str
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.cache: dict[str, int] = {}
        self.held = 0

    def pieces(self, text: str) -> list[str]:
        if text.isascii() or not self.beyond(text):
            return self.find(text)
        return [w for w, _ in self.cut_by_library(text)]

    def count(self, text: str | None) -> int:
        return self.count_all([text])[0]

    def count_all(self, texts: list[str | None]) -> list[int]:
        """The tokens of each text; the words of all texts are looked up side by side."""
        words: list[str] = []
        ends, special = [0], []
        for text in texts:
            parts = self.special.split(text or "") if self.special else [text or ""]
            for part in parts:
                words += self.pieces(part)
            ends.append(len(words))
            special.append(len(parts) - 1)
        upto = np.zeros(len(words) + 1, np.int64)
        for k in range(0, len(words), SLICE):
            upto[k + 1 : k + 1 + SLICE] = self.lengths(words[k : k + SLICE])
        upto = np.cumsum(upto)
        return (upto[ends[1:]] - upto[ends[:-1]] + np.array(special, np.int64)).tolist()

    def lengths(self, words: list[str]) -> np.ndarray:
        out = self.frequent.of(words)
        misses = np.flatnonzero(out < 0)
        if len(misses):
            out[misses] = self.cached([words[k] for k in misses.tolist()])
        return out

    def cached(self, words: list[str]) -> list[int]:
        """The second tier: counts from the worker's cache, into which new words go."""
        if self.held > CACHE:
            self.cache, self.held = {}, 0
        known = self.cache
        new = list(set(words).difference(known))
        size = sum(map(len, new)) + 150 * len(new)
        if self.held + size > 2 * CACHE:  # so many new words at once are counted by a table of their own
            known = dict(known)
        else:
            self.held += size
        for k in range(0, len(new), 4096):
            some = new[k : k + 4096]
            known.update((w, len(e.ids)) for w, e in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False), strict=True))
        return list(map(known.__getitem__, words))


_counters: dict[int, tuple] = {}


def counter(key: tuple) -> TokenCounter:
    """Built once in each worker for a broadcast value."""
    if id(key) not in _counters:
        _counters.clear()
        _counters[id(key)] = (key, TokenCounter(*key))
    return _counters[id(key)][1]


def frequent_words(docs: DataFrame, text: str = "text") -> list[str]:
    """The most frequent pre-tokens of a sample, most frequent first: the SAMPLE_ROWS different texts of at most
    SAMPLE_BYTES bytes that have the least hashes."""
    t = docs.select(F.col(text).alias("t"), F.xxhash64(F.lit(5), text).alias("h")).filter(F.octet_length("t").between(1, SAMPLE_BYTES))
    least = [r["h"] for r in t.groupBy("h").agg(F.lit(1)).orderBy("h").limit(SAMPLE_ROWS).select("h").collect()]
    few = docs.sparkSession.createDataFrame([(h,) for h in least], "h long")
    texts = t.join(F.broadcast(few), "h").groupBy("h").agg(F.min("t").alias("t"))
    seen: Counter = Counter()
    find = regex.compile(PATTERN).findall
    for r in texts.collect():  # SAMPLE_ROWS at most
        seen.update(w for w in find(r["t"]) if "\0" not in w)
    return [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT]]


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row."""
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = f.read()
    words = frequent_words(docs, text)
    model = Tokenizer.from_str(tokenizer)
    model.encode_special_tokens = True
    lengths = [len(e.ids) for e in model.encode_batch(words, add_special_tokens=False)]
    table = [(w, n) for w, n in zip(words, lengths, strict=True) if n < 256]
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer, Lengths([w for w, _ in table], bytes(n for _, n in table))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(shared.value)
        for batch in lean(batches):
            out = [n for part in chunks(batch.column(2), 1_500_000) for n in c.count_all(part.to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(out, np.int64))], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("t"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of documents."""
    import public_tokenizers

    counts = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
