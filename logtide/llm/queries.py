"""The registered query of each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm import bpe, chat, language, minhash, mixing, pii, quality, repair, search, simplex, toxicity, urls, vectors
from logtide.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


def op2_dual_tree_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identified(table(spark, folder, "documents"))


def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judged(table(spark, folder, "pages"), urls.rules_table(spark, urls.RULES))


def op5_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents"))


def op6_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat.read_back(chat.formatted(chat.with_added(table(spark, folder, "conversations"))))


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


def op11_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.judged(table(spark, folder, "documents"))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.judged(table(spark, folder, "conversations"))


def op13_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return simplex.judged(table(spark, folder, "embeddings"))


def queries() -> dict[str, Query]:
    found = (op1_byte_bpe, op2_dual_tree_search, op3_language_id, op4_url_filters, op5_source_mixing, op6_chat_formatting, op7_quality_classifier, op8_embedding_near_dedup, op9_toxicity, op10_minhash_near_dedup,
             op11_pii, op12_conversation_repair, op13_centroid_clustering)
    return {query.__name__: query for query in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_dual_tree_search": search.sql(),
        "op4_url_filters": urls.sql(),
        "op5_source_mixing": mixing.sql(),
        "op6_chat_formatting": chat.sql(),
        "op12_conversation_repair": repair.sql(),
        "op13_centroid_clustering": simplex.sql(),
    }
