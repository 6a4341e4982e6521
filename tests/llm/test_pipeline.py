import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def alike(rows):
    return sorted(str(tuple(r)) for r in rows)


def test_stages_by_brute_force(spark, docs, tmp_path):
    """Each stage on what the one before it left, against plain Python; and run() against them all."""
    import hashlib

    import public_tokenizers
    from pyspark.sql import functions as F
    from test_dedup import LOW, by_brute_force, shingles
    from test_storage import mix_by_hand
    from test_text import by_search
    from tokenizers import Tokenizer

    from halfstep.llm.common import unit
    from halfstep.llm.langid import sample

    foreign = "".join(chr(0xAC00 + k) for k in range(90))
    more = spark.createDataFrame([(700, foreign, None, "z", 1), (701, foreign[:9], None, "z", 1), (702, "1 " * 300 + "kg", None, "z", 1)], docs.schema)
    docs = docs.union(more)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    left = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        left.append(docs.collect())
    assert all(r.__fields__ == left[0][0].__fields__ for rows in left[:-1] for r in rows)

    known = sample(spark.read.parquet(str(tmp_path / "documents.parquet")))
    found = {id(r): by_search(r["text"] or "", known) for r in left[0]}
    assert all(max(n - 8, 0) / max(m, 1) * 1.5 <= 0.6 for r in left[0] if r["lang"] for _, _, n, m in [found[id(r)]])  # so 0.6 holds for all
    stays = [r for r in left[0] if found[id(r)][0] != "und" and found[id(r)][2] <= 8 + 0.6 * found[id(r)][3]]
    assert alike(left[1]) == alike(stays)
    assert {r["doc_id"] for r in left[0]} - {r["doc_id"] for r in left[1]} == {1, 2, 3, 4, 700}

    best = {}
    for r in left[1]:
        t = (r["text"] or "").translate(LOW)
        if t not in best or (best[t]["doc_id"] is None, -(best[t]["doc_id"] or 0)) > (r["doc_id"] is None, -(r["doc_id"] or 0)):
            best[t] = r
    assert alike(left[2]) == alike(best.values())

    rows = [(r["doc_id"], r["text"]) for r in left[2]]
    five = by_brute_force(rows, 80, lambda t: shingles(t, 5))
    assert sorted(r["doc_id"] or -1 for r in left[3]) == sorted({c or -1 for _, n, c in five if n} | {d or -1 for d, n, _ in five if not n})

    import re

    sizes = [(k, len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")), r["source"]) for k, r in enumerate(left[3])]
    u = spark.createDataFrame(left[3], spark.read.parquet(str(tmp_path / "near_dedup")).schema)
    numbers = {(r["doc_id"], r["text"]): r["u"] for r in u.select("doc_id", "text", unit("doc_id", F.unhex(F.md5("text")), F.lit(0).cast("long"), seed=11).alias("u")).collect()}
    copies = mix_by_hand(sizes, random={k: numbers[r["doc_id"], r["text"]] for k, r in enumerate(left[3])})
    assert alike(left[4]) == alike(r for k, r in enumerate(left[3]) for _ in range(copies[k]))

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in left[4]:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], r["lang"], r["source"], len(ids), ids, hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert alike(left[5]) == sorted(map(str, want))
    assert alike(corpus_pipeline.run(spark, str(tmp_path)).collect()) == alike(left[5])


def test_an_empty_table_and_columns_with_clashing_names(spark, docs, clashing, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    few = clashing.filter("doc_id between 10 and 17 or doc_id = 100").withColumn("_stage_lang", clashing["doc_id"]).withColumn("_stage_phrases", clashing["doc_id"])
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, few, "").columns == few.columns


def test_queries_are_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names


def test_scripts_of_many_letters_are_not_foreign(spark):
    import numpy as np

    r = np.random.default_rng(5)
    odds = 1 / np.arange(1, 1501)

    def some(n):
        return "".join(chr(0x4E00 + int(k)) for k in r.choice(1500, n, p=odds / odds.sum()))

    rows = [(k, some(300), "zh") for k in range(60)] + [(100 + k, "plain words of a script with few letters " * 3, "en") for k in range(20)]
    rows.append((500, "".join(chr(0xAC00 + k) for k in range(90)), None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()} == {d for d, _, _ in rows} - {500}


@pytest.mark.parametrize("name", ["op5_merkle_audit", "op6_exact_dedup"])
def test_query_equals_sql(spark, name):
    import duckdb

    from halfstep.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    want, got = con.sql(SQL[name]).df(), QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()
    columns = sorted(want.columns)
    order = columns[:1] if name.startswith("op6") else ["page_id"]
    a, b = (d[columns].sort_values(order).reset_index(drop=True).astype(object).where(d[columns].sort_values(order).reset_index(drop=True).notna(), None) for d in (got, want))
    assert sorted(got.columns) == columns and a.equals(b)
