"""Helpers shared by the training-data operators: tables, held-out parts, bounded samples, components."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.runtime import new_path, stored


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def batch_rows(spark: SparkSession, rows: int) -> None:
    """Rows of an Arrow batch from here on: few where a row is large, so that a batch stays small in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def short_plans(spark: SparkSession) -> None:
    """The driver keeps the text of every plan; with tables as literals that would be megabytes for each."""
    spark.conf.set("spark.sql.maxPlanStringLength", "20000")


def released(spark: SparkSession) -> None:
    """Frees what finished work left on the driver: models and broadcasts that nothing refers to, and the heap grown for them.

    Spark drops unreferenced broadcasts and shuffles only after a collection, which a heap with room left never makes.
    What a frame still needs is referred to by it and stays.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


# Rows of a batch of whole texts, and of rows that hold a block of vectors.
TEXT_ROWS, BLOCK_ROWS = 1_000, 32


def unused(frame: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column has it in any case."""
    taken = {column.lower() for column in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_part(column: str, parts: int) -> Column:
    """crc32 of the value as text, modulo `parts`; null for a null value."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def sample_by_hash(rows: DataFrame, key: str, bound: int, *order: str) -> DataFrame:
    """The `bound` rows that come first by hash of `key`; repeatable, independent of row placement."""
    return rows.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), key, *order).limit(bound)


def texts_of(sample: DataFrame, documents: DataFrame) -> DataFrame:
    """Texts of a sample of bounded size: the sample is the broadcast side, the documents stay where they are."""
    return documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")


def replaced(frame: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: cuts lineage without local copies."""
    return stored(frame, name)


def _smaller_ends(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b); component is the smallest node reachable.

    Alternates star contractions. Each step needs only the smallest neighbour of a node, a partial aggregate,
    and a join that adaptive execution splits at hot nodes; no neighbour list is ever gathered. The links of a
    step are written to the shared folder, so a lost executor costs one step at most.
    """
    links = replaced(_smaller_ends(edges), "links")
    state = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        links = replaced(_smaller_ends(small), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state is not None and tuple(now) == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                links.select(F.col("b").alias("node"), F.col("b").alias("component"))
            ).distinct()
        state = tuple(now)


__all__ = ["BLOCK_ROWS", "TEXT_ROWS", "batch_rows", "components", "crc_part", "new_path", "released", "replaced", "sample_by_hash", "short_plans", "stored", "table", "texts_of", "unused"]
