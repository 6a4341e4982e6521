"""BPE encoding and decoding with a contiguous rank array.

A word is held as an array of part boundaries with the ranks of adjacent pairs beside it. The least rank is found by a
scan, the boundary within that pair is deleted, and the ranks of its two neighbours are refreshed, until no pair has a
rank. Words of over SHORT parts use a heap over the same ranks, with the same result. Each worker keeps the ids of words
it has met, up to CACHE bytes of them.

Text goes the way of the tokenizer's file: special tokens first, in the text as it is; then NFC, white space, lower case
by single characters; then words by the file's pattern; then bytes. Texts with characters from U+0300 on are normalised
and cut into words by the library, so that its version of Unicode holds. Decoding joins the tokens with a space, as the
file names no decoder. Null counts as empty; an empty text has no ids and decodes to an empty text. Repeated rows are
coded alike, and an empty table gives an empty one.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, table
from .langid import chunks, forget

SHORT, CACHE, NONE = 128, 48 << 20, 1 << 60


def byte_letters() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable ones for themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Bpe:
    """Encoder and decoder of a tokenizer's file, for one worker."""

    def __init__(self, file: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        spec = json.loads(file)
        model = spec["model"]
        vocabulary: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        self.tokens = [""] * (max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, k in vocabulary.items():
            self.tokens[k] = token
        for t in spec["added_tokens"]:
            self.tokens[t["id"]] = t["content"]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocabulary[a], vocabulary[b]), (rank, vocabulary[a + b]))
        letters = byte_letters()
        self.inner = [vocabulary[c] for c in letters]
        self.last = [vocabulary[c + end] for c in letters]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(pattern).findall
        self.cut_by_library = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str
        self.beyond = regex.compile("[^\\x00-\\u02ff]").search
        self.normalised = Tokenizer.from_str(file).normalizer.normalize_str  # the file's Unicode version, not Python's
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.hints = {content[0] for content in self.special}
        self.known: dict[str, bytes] = {}
        self.held = 0

    def word(self, word: str) -> list[int]:
        raw = word.encode()
        parts = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        return self.merged(parts) if len(parts) <= SHORT else self.merged_long(parts)

    def merged(self, parts: list[int]) -> list[int]:
        """parts[i] is what lies between boundaries i and i + 1; ranks[i] is the rank of parts i and i + 1."""
        get = self.merges.get
        none = (NONE, 0)
        ranks = [get(p, none)[0] for p in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = self.merges[parts[i], parts[i + 1]][1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)[0]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)[0]
        return parts

    def merged_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, parts[i], parts[i + 1]) for i in range(n - 1) if (m := self.merges.get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if parts[i] == a else n
            if j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = self.merges[a, b][1], -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
            for x, y in ((left[i], i), (i, k)):
                if x >= 0 and y < n and (m := self.merges.get((parts[x], parts[y]))):
                    heapq.heappush(heap, (m[0], x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def words(self, text: str) -> list[str]:
        if text.isascii() or not self.beyond(text):  # such text is its own NFC
            return self.find(text.lower())
        return [w for w, _ in self.cut_by_library(self.normalised(text))]

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as 32-bit numbers."""
        if not text:
            return b""
        if any(h in text for h in self.hints) and len(parts := self.at_special.split(text)) > 1:
            return b"".join(np.int32(self.special[p]).tobytes() if k % 2 else self.encode_plain(p) for k, p in enumerate(parts))
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> bytes:
        words, known = self.words(text), self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            if self.held > CACHE:
                known.clear()
                self.held = 0
            more = {w: np.array(self.word(w), np.int32).tobytes() for w in set(words).difference(known)}
            size = sum(len(w) + len(ids) + 180 for w, ids in more.items())
            if self.held + size <= 2 * CACHE:
                known.update(more)
                self.held += size
                return b"".join([known[w] for w in words])
            # a text with so many words of its own is coded from a table of its own
            return b"".join([known[w] if w in known else more[w] for w in words])

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


_coders: dict[str, Bpe] = {}


def coder(file: str) -> Bpe:
    """Built once in each worker."""
    if file not in _coders:
        _coders.clear()
        forget()  # a worker of a pipeline holds one stage's tables at a time
        _coders[file] = Bpe(file)
    return _coders[file]


def with_ids(docs: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """docs with the ids of each text and, if wanted, the text that the ids decode to, in place of the text column and of
    columns that have these names already (to keep the text, name it twice)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    at = docs.columns.index(text)
    fields = [f for f in docs.schema.fields if f.name not in (text, ids, decoded)]
    kept = [docs.columns.index(f.name) for f in fields]
    new = [T.StructField(ids, T.ArrayType(T.IntegerType(), False)), *([T.StructField(decoded, T.StringType())] if decoded else [])]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(shared.value)
        for batch in lean(batches):
            done = 0
            for part in chunks(batch.column(at), 1_500_000):
                raw = [c.encode(t) for t in part.to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int32)
                flat = np.frombuffer(b"".join(raw), np.int32)
                columns = [batch.column(k).slice(done, len(part)) for k in kept]
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())))
                if decoded:
                    columns.append(pa.array([c.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string()))
                done += len(part)
                yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in fields), *(f.name for f in new)])

    return docs.mapInArrow(encode, T.StructType([*fields, *new]))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 from ids and decoded."""
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of documents."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(with_ids(docs, public_tokenizers.path("word_bpe_49k.json")))
