"""Tokenizer alignment against whole texts encoded by both libraries and aligned by sets of offsets."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from halfstep.llm import alignment as A

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = ["▁a text with the mark", "two  spaces   and\ttabs \n\n new lines", " leads", "trails  ", "<s> <0x0A> </s> <unk> <|endoftext|>", "é é ﬁ ① Ａ 　   ᠎ x", "日本語 テキスト 🙂🙂🏽", "a\x00b \x1c c \x85 d", "\r\n", " ", "don't we'll I'M", "x" * 3000, "aé🙂" * 400]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FIRST)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=SECOND)


def brute_force(texts, libraries):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text."""
    a, b = libraries
    values = A.byte_values()

    def spans(parts):
        out, at = [], 0
        for i, raw in parts:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out, b"".join(raw for _, raw in parts)

    every = []
    for t in texts:
        if not t:
            every.append(None)
            continue
        x, raw_x = spans([(i, bytes(values[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids])
        y, raw_y = spans([(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(t)])
        if not raw_x == raw_y == (" " + t).encode():
            every.append(None)
            continue
        cuts = sorted({e for *_, e in x} & {e for *_, e in y})
        groups = [([i for i, _, e in x if lo < e <= hi], [i for i, _, e in y if lo < e <= hi]) for lo, hi in zip([0, *cuts], cuts)]
        links = Counter((i, j) for p, q in groups for i in p for j in q)
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        every.append((len(x), len(y), len(groups), links, hashlib.sha256(text.encode()).hexdigest()))
    counts = Counter(pair for m in every if m for pair in m[3])
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    return [(m[0], m[1], m[2], sum(m[3].values()), sum(n for p, n in m[3].items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in m[3].items()), m[4]) if m else (0, 0, 0, 0, 0, 0, "") for m in every]


@pytest.mark.parametrize("head", [A.HEAD, 40, 0])
def test_alignment_equals_brute_force(docs, libraries, head):
    given = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame([(1000 + k, t) for k, t in enumerate(HARD)], "doc_id long, text string"))
    rows = [tuple(r) for r in given.collect()]
    want = [(d, *m) for (d, _), m in zip(rows, brute_force([t for _, t in rows], libraries))]
    got = [tuple(r) for r in A.align(given, FIRST, SECOND, head=head).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(r[0] == 1000 and r[1] == 0 for r in got)  # U+2581 comes back as a space


def test_short_lots_and_forgotten_segments(monkeypatch):
    tool = A.Aligner(open(FIRST, encoding="utf-8").read(), open(SECOND, "rb").read())
    text = " ".join(f"w{k} it's Ünïcode  🙂{k}\n" for k in range(300))
    (whole,) = tool.measured([text])
    monkeypatch.setattr(A, "LOT", 7)
    monkeypatch.setattr(A, "SEGMENTS", 20)
    few = tool.measured([text, "a few words", text])
    assert few[1][0] == 3
    for again in (few[0], few[2]):
        assert whole[:5] == again[:5] and whole[5].tolist() == again[5].tolist() and whole[6].tolist() == again[6].tolist()


def test_largest_counts_are_the_first_tier(spark):
    counts = spark.createDataFrame([(k, 0, n) for k, n in enumerate([1, 1, 5, 5, 9000, 9001, 10**12])], "a int, b int, n long")
    assert [counts.filter(F.col("n") >= A.first_tier(counts, most)).count() for most in (0, 1, 3, 4, 5, 100)] == [0, 1, 3, 3, 5, 7]


def test_alignment_of_clashing_columns_and_of_nothing(docs, clashing, empty):
    want = sorted(map(str, A.align(docs, FIRST, SECOND).collect()))
    assert sorted(map(str, A.align(clashing, FIRST, SECOND).collect())) == want
    assert A.align(empty, FIRST, SECOND).collect() == []
