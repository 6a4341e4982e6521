"""A training corpus from the documents: language ID, exact dedup, near dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. An empty table passes through all of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halfstep.llm.bpe import with_ids
from halfstep.llm.common import done, scratch, table
from halfstep.llm.exact_dedup import drop_exact
from halfstep.llm.jaccard_join import drop_near
from halfstep.llm.langid import held_out, identify, sample
from halfstep.llm.mixing import mix

#: A text is in none of the languages learned if it needs over SLACK + rate * letters phrases in the one that fits best. A
#: text of letters never seen needs one a letter. The rate is FOREIGN_RATE (running text of a learned language of few
#: letters stays below 0.4), or MARGIN times that below which 99 % of a language's labelled rows stay that were not learned
#: from, if that is more, up to MOST_RATE.
FOREIGN_RATE, SLACK, MARGIN, MOST_RATE = 0.6, 8, 1.5, 0.99
#: Near copies share this many in a hundred of their shingles of so many words, at least. (op8 has numbers of its own.)
NEAR_WORDS, NEAR_PERCENT = 5, 80

#: Rows and bytes of a batch that goes to a Python worker, at most: each running task holds one in the JVM and one in Python.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def _small_batches(spark: SparkSession) -> None:
    for name, most in BATCH.items():
        if not 0 < int(spark.conf.get(name).rstrip("b")) <= most:
            spark.conf.set(name, str(most))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages; those without a letter (or null) and those in none of them go. Repeated
    rows share their fate; with no labelled row at all none stays."""
    _small_batches(spark)
    texts, names = sample(docs), ("_stage_lang", "_stage_score", "_stage_phrases", "_stage_letters")
    found = identify(docs, texts, names=names)
    apart = docs.select("doc_id", "lang", "text").filter(held_out(F.col("doc_id")) & F.col("lang").isin(*texts))
    rate = F.greatest(F.col("_stage_phrases") - SLACK, F.lit(0)) / F.col("_stage_letters")
    # exact counts by rates in thousandths: the least rate up to which 99 in a hundred lie doesn't depend on the order of rows
    counts = identify(apart, texts, names=names).filter("lang = _stage_lang").groupBy("lang", F.ceil(rate * 1000).alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy("lang")
    upto, every = F.sum("_n").over(by.orderBy("_at")), F.sum("_n").over(by)
    rates = counts.withColumn("_enough", 100 * upto >= 99 * every).filter("_enough").groupBy("lang").agg((F.min("_at") / 1000).alias("rate"))
    most = F.lit(FOREIGN_RATE)
    for r in rates.collect():  # a row for each language learned
        most = F.when(F.col("_stage_lang") == r["lang"], F.lit(min(MOST_RATE, max(FOREIGN_RATE, MARGIN * r["rate"])))).otherwise(most)
    foreign = F.col("_stage_phrases") > SLACK + most * F.col("_stage_letters")
    return found.filter((F.col("_stage_lang") != "und") & ~foreign).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty) the document with the largest doc_id, null being less than any."""
    _small_batches(spark)
    return drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links connect: a Jaccard similarity of 0.8 or more of the sets of five-word
    shingles. Texts without a word all stay."""
    _small_batches(spark)
    return drop_near(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which may be never; texts without a word go with certain copies only."""
    _small_batches(spark)
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and the SHA-256 of the text that the ids decode to, for every row; null counts
    as empty and has no ids."""
    _small_batches(spark)
    coded = with_ids(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("tokens", tokens)]

#: SQL can't express the parse against suffix automata or the merges of BPE; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch() as keep:  # what a stage writes for itself goes when its result is written
            out = keep(stage(spark, docs, sf_dir))
        if docs is not given:
            done(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
