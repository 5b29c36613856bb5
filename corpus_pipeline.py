"""A training corpus from raw documents: quality, language, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir); `run` writes what a stage returns to the shared folder and reads it again
as the documents of the next one. All stages but the last return the columns of the documents they got, also those with
names that the operators use themselves. Each begins by freeing what the one before left on the driver.

Null and empty texts: scored 0.5 and so kept by the quality stage, dropped by the language stage as they have no letters.
A null id, source or language: learned from nowhere, judged like any other row. Ties: the smallest id of a component stays.
Rows that repeat an id: one of them stays after the near-dedup stage. Empty tables give empty results. Texts of any
length are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm import bpe, language, minhash, mixing, quality
from logtide.llm.common import crc_part, released, replaced, short_plans, table, unused

# Documents below this probability of their language leave the corpus.
LEAST_LANGUAGE = 0.5
RANKS = "byte_bpe_multi_50k.tiktoken"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents scored below the threshold go."""
    released(spark)
    short_plans(spark)
    known = table(spark, sf_dir, "labels").where(crc_part("doc_id", 5) != 0)
    score = unused(docs, "__quality")
    scored = quality.with_score(docs, quality.fit(docs, known), score)
    return scored.where(F.col(score) >= quality.THRESHOLD).drop(score)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without letters or without a clear language go."""
    released(spark)
    model = language.fit(docs.where(crc_part("doc_id", 4) != 2))
    name, sure = unused(docs, "__name"), unused(docs, "__sure")
    named = language.with_language(docs, model, name, sure)
    return named.where((F.col(name) != "und") & (F.col(sure) >= LEAST_LANGUAGE)).drop(name, sure)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: the document with the smallest id of each component stays, once if its row repeats.

    Rows without doc_id stay: nothing is known to equal them.
    """
    released(spark)
    kept = minhash.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    chosen = docs.join(replaced(kept, "kept"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return chosen.unionByName(docs.where("doc_id IS NULL"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents sampled so that sources, languages and topics meet their target weights."""
    released(spark)
    return mixing.kept(docs).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: the number of tokens of each document and the digests of its ids and of its decoded bytes."""
    released(spark)
    return bpe.digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near-dedup", keep_one_of_each),
    ("mixing", mix),
    ("tokens", tokenize),
]

# The classifiers are trained models and the tokenizer is no SQL function.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = replaced(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
