"""Small tables with nulls, empty texts, ties, repeated rows and columns whose names clash with the operators' own."""

import pytest

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def word(k: int) -> str:
    return LETTERS[k % 26] + LETTERS[k // 26 % 26] + LETTERS[k // 676 % 26]


def running(seed: int, n: int) -> list[str]:
    x, out = seed * 7919 + 1, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(word(x >> 12))
    return out


def rows() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars)."""
    out: list[tuple] = [(None, "the house is here", "en", None, 1), (None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t", None, "b", 3), (4, "!!! 123 ...", "en", "b", 5)]
    for k in range(40):
        base = running(k // 4, 60 + 10 * (k // 4))
        base = base if k % 4 == 0 else [*base[:20], f"x{k}", *base[21:]] if k % 4 == 1 else base[: -3 * (k % 4)]
        out.append((10 + k, " ".join(base), ("en", "fr")[k // 4 % 2], f"src{k % 3}", 1))
    same = " ".join(running(99, 50))
    out += [(100 + k, same if k % 2 else same.upper(), "en", "src0", 1) for k in range(12)]
    out += [(200, same, "en", "src0", 1)] * 3  # repeated rows
    out += [(300, "Ünïcode 日本 🙂 <|endoftext|> it's", "fr", "z", 1), (301, "tiny", "fr", "z", 1), (302, "long " * 5000, "en", "z", 1)]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that the operators use inside.
EXTRA = (
    "size", "shard", "score", "lang_pred", "ids", "decoded", "node", "key", "root", "th", "k", "n", "token", "copies", "row", "slot", "law", "target", "taken", "keep_id", "kept", "source_size", "n_bytes", "n_tokens",
    "_key", "_id", "_row", "_sha", "_length", "_prefix", "_alive", "_whole", "_own", "_copies", "_rows", "_hash", "_from", "_of", "_times", "_copy", "_bucket", "_start", "_whole_row", "_to", "_bin", "_n",
)


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(7) for c in EXTRA})
