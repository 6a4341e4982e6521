"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed against it from left to right into the
longest phrases that occur in the labelled text. A phrase costs the logarithm of the labelled text's length, as it is
named by a place there; the language in which the text costs least wins (the first in code-point order if equal). Many texts
are parsed in step by numpy: an automaton with its restarts is a table of states by the language's letters, or, where the
tables of a worker come to DENSE bytes, its edges in order, in which a state's are searched.

Text is lower-cased letters with one space for each run of anything else. Long texts are parsed in blocks side by side;
blocks are parsed again from the state in which the one before them ends until no such state changes, so a text has just
the phrases of one parse from its beginning to its end. Null texts and texts without a letter give `und` with score 0. The
score is 1 - least / second least cost. With no labelled row every text with a letter is `und`.

Labelled text is a bounded sample of labelled rows: for each label the different texts of least hash, up to ROWS of them and
until they have its share of characters, SAMPLE_CHARS, or SAMPLE_TOTAL over the number of labels if that is less; texts of
over LONG characters come after all others, the shorter ones first. Every label is learned; a text of more characters than
the share is learned from as far as that goes. So the driver gets twice SAMPLE_TOTAL characters at most. Rows that repeat a
text count once, so neither they nor another language take a language's place.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, small, table

#: Bounds of the sample, and the length that a phrase's cost is at least taken from.
ROWS, SAMPLE_CHARS, SAMPLE_TOTAL, LONG, LEAST_CHARS = 48, 24_576, 16 << 20, 4_096, 4_096
#: Characters in a block, characters parsed at once, and bytes of tables in a worker (this only affects memory and speed).
BLOCK, CHUNK, DENSE = 2_048, 1_000_000, 128 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, rows: int = ROWS, chars: int = SAMPLE_CHARS, total: int = SAMPLE_TOTAL) -> dict[str, str]:
    """Labelled text for each language, from rows that aren't held out. Hashes are ranked and texts chosen by running length
    where the rows are; only the chosen ones come to the driver."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text")
    usable = usable.withColumns({"n": F.length("text"), "h": F.xxhash64(F.lit(3), "text")}).filter("n > 0")
    labels = usable.select("lang").distinct().count()
    if not labels:
        return {}
    share = min(chars, max(1, total // labels))
    by = Window.partitionBy("lang")
    rank = F.row_number().over(by.orderBy(F.when(F.col("n") > LONG, F.col("n")).otherwise(0), "h"))
    ranked = usable.select("lang", "n", "h").distinct().withColumn("nth", rank).filter(F.col("nth") <= rows)
    before = F.coalesce(F.sum("n").over(by.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = [(r["lang"], r["h"], r["nth"]) for r in ranked.withColumn("before", before).filter(F.col("before") < share).collect()]
    few = docs.sparkSession.createDataFrame(chosen, "lang string, h long, nth int")
    texts = usable.join(small(few), ["lang", "h"]).groupBy("lang", "nth").agg(F.min(F.substring("text", 1, share)).alias("text"))
    kept: dict[str, list[str]] = {}
    for r in sorted(texts.collect(), key=lambda r: (r["lang"], r["nth"])):
        kept.setdefault(r["lang"], []).append(r["text"])
    return {lang: " ".join(part) for lang, part in kept.items()}


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the start, from which exactly the substrings of text can be read."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Automaton:
    """One language's suffix automaton with its restarts, by steps of many texts at once. A step gives the next state times
    4, plus the phrases that end: 0 where a phrase goes on, 1 where another begins with this character, 2 where one ends and
    the character, which the labelled text lacks, is one too. States are multiplied by width, in a table the row's length."""

    def __init__(self, codes: np.ndarray, kinds: int, room: int):
        own = np.unique(codes)
        self.local = np.full(kinds, len(own), np.min_scalar_type(len(own)))  # letters of other languages have the last code
        self.local[own] = np.arange(len(own))
        step = suffix_automaton(self.local[codes].tolist())
        degree = np.array([len(e) for e in step])
        state = np.repeat(np.arange(len(step)), degree)
        letter = np.fromiter((c for e in step for c in e), np.int32, len(state))
        to = np.fromiter((t for e in step for t in e.values()), np.int64, len(state))
        restart = np.full(len(own) + 1, -1, np.int64)
        restart[list(step[0])] = list(step[0].values())
        self.bytes = 4 * len(step) * len(restart)
        self.table = None
        if self.bytes <= min(room, 1 << 29):  # entries stay below 2^31
            self.width = len(restart)
            t = np.broadcast_to(np.where(restart >= 0, (restart * self.width) << 2 | 1, 2), (len(step), self.width)).astype(np.int32)
            t[0, restart < 0] = 1
            t[state, letter] = (to * self.width) << 2
            self.table = t.ravel()
            return
        order = np.lexsort((letter, state))
        self.width, self.letter, self.to, self.restart = 1, letter[order], to[order].astype(np.int32), restart
        self.first = np.concatenate([[0], np.cumsum(degree)])
        self.bytes = 0

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[state + code]
        low, end = self.first[state], self.first[state + 1]
        n, last = end - low, len(self.letter) - 1
        while n.any():  # the first edge of a state whose letter isn't less
            half = n >> 1
            less = (n > 0) & (self.letter[np.minimum(low + half, last)] < code)
            low, n = np.where(less, low + half + 1, low), np.where(less, n - half - 1, half)
        at = np.minimum(low, last)
        again = self.restart[code]
        other = np.where(again >= 0, again << 2 | 1, np.where(state == 0, 1, 2))
        return np.where((low < end) & (self.letter[at] == code), self.to[at].astype(np.int64) << 2, other)


class Parser:
    """The automata of several languages."""

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        self.cost = np.log2([max(LEAST_CHARS, len(texts[lang])) for lang in self.languages])
        #: 0: no letter; 1: a letter that no labelled text has; above: letters of the labelled texts.
        folded = {cp: low for cp in range(0x110000) if (ch := chr(cp)).isalpha() for low in [ch.lower() if len(ch.lower()) == 1 else ch]}
        letters = {ch: k + 2 for k, ch in enumerate(sorted({folded[ord(ch)] for t in texts.values() for ch in set(t) if ch.isalpha()}))}
        self.kind = np.zeros(0x110000, np.min_scalar_type(len(letters) + 1))
        self.kind[list(folded)] = [letters.get(low, 1) for low in folded.values()]
        self.automata, room = [], DENSE
        for lang in self.languages:
            codes, _ = self.normalised(texts[lang])
            self.automata.append(Automaton(codes, len(letters) + 2, room))
            room -= self.automata[-1].bytes

    def normalised(self, text: str, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The kinds of the characters of texts that stand one after another, runs without letters made one; how many
        each text has."""
        codes = self.kind[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        lengths = np.array([len(text)]) if lengths is None else lengths
        is_letter = codes > 0
        before = np.zeros(len(codes), bool)
        before[1:] = is_letter[:-1]
        first = (np.cumsum(lengths) - lengths)[lengths > 0]
        before[first] = False
        keep = is_letter | before
        upto = np.concatenate([[0], np.cumsum(keep)])
        ends = np.cumsum(lengths)
        return codes[keep], upto[ends] - upto[ends - lengths]

    def phrases(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases that each text needs in each language."""
        blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(lengths)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = (np.cumsum(lengths) - lengths)[owner] + nth * BLOCK
        size = np.minimum(BLOCK, lengths[owner] - nth * BLOCK)
        last = np.ones(len(owner), bool)
        last[:-1] = owner[1:] != owner[:-1]
        out = np.zeros((len(lengths), len(self.languages)), np.int64)
        for k, automaton in enumerate(self.automata):
            mine = automaton.local[codes]
            enter = np.zeros(len(size), np.int64)
            count, leave = self.parsed(automaton, mine, begin, size, enter)
            while True:
                again = np.flatnonzero((nth > 0) & (np.roll(leave, 1) != enter))
                if not len(again):
                    break
                enter[again] = leave[again - 1]
                count[again], leave[again] = self.parsed(automaton, mine, begin[again], size[again], enter[again])
            out[:, k] = np.bincount(owner, count + ((leave != 0) & last), len(lengths))
        return out

    def parsed(self, automaton: Automaton, codes: np.ndarray, begin: np.ndarray, size: np.ndarray, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end in each block, and the states after it, from the states before it."""
        order = np.argsort(-size, kind="stable")
        begin, size, state = begin[order], size[order], enter[order]
        count = np.zeros(len(state), np.int64)
        active = len(size) - np.searchsorted(size[::-1], np.arange(size[0] if len(size) else 0), side="right")
        for t, n in enumerate(active.tolist()):
            x = automaton.step(state[:n], codes[begin[:n] + t])
            count[:n] += x & 3
            state[:n] = x >> 2
        back = np.argsort(order)
        return count[back], state[back]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Languages, scores, phrases in the language that wins (0 for `und`), and how many characters were parsed."""
        texts = [t or "" for t in texts]
        codes, lengths = self.normalised("".join(texts), np.array([len(t) for t in texts], np.int64))
        if not self.languages or not len(codes):
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64), lengths
        need = self.phrases(codes, lengths)
        cost = need * self.cost
        best = cost.argmin(1)
        two = np.sort(cost, 1)[:, :2]
        some = lengths > 0
        second = two[:, 1] if cost.shape[1] > 1 else (lengths + 1) * self.cost[0]
        score = np.where(some, 1 - two[:, 0] / np.maximum(second, 1), 0.0)
        return [self.languages[k] if ok else "und" for k, ok in zip(best, some, strict=True)], score, need[np.arange(len(need)), best], lengths


_parsers: dict[bytes, Parser] = {}


def parser(texts: bytes) -> Parser:
    """Built once in each worker."""
    if texts not in _parsers:
        _parsers.clear()
        _parsers[texts] = Parser(pickle.loads(texts))
    return _parsers[texts]


def forget() -> None:
    """Lets go of the parser that a worker holds; the next batch that needs it builds it again."""
    _parsers.clear()


def chunks(texts: pa.Array, chars: int) -> Iterator[pa.Array]:
    """Slices of texts with about this many characters, at least one text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chars, side="right")))
        yield texts.slice(at, upto - at)
        at = upto


NAMES = ("lang_pred", "score", "phrases", "letters")


def identify(docs: DataFrame, texts: dict[str, str], text: str = "text", names: tuple[str, str, str, str] = NAMES) -> DataFrame:
    """docs with the language and score of each text, its phrases, and the number of its letters and the spaces between
    them, from labelled text by language. Columns that have these names already are replaced."""
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(texts))
    at = docs.columns.index(text)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(shared.value)
        for batch in lean(batches):
            found = [p.predict(part.to_pylist()) for part in chunks(batch.column(at), CHUNK)]
            new = [pa.array([x for f in found for x in f[0]], pa.string())]
            new += [pa.array(np.concatenate([f[k] for f in found]) if found else [], kind) for k, kind in ((1, pa.float64()), (2, pa.int64()), (3, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])

    kinds = (T.StringType(), T.DoubleType(), T.LongType(), T.LongType())
    return docs.mapInArrow(predict, T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(names, kinds, strict=True))]))


def op1_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, phrases, letters of every row of documents."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(rows, sample(docs)).select("doc_id", "held_out", *NAMES)
