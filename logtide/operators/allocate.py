"""Exact quotas and near-equal chunks, both in a seeded order computed without one-task windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtide.operators.skew import hash_digit, hash_order, running_totals


def ranked(frame: DataFrame, stratum: str, row_id: str, seed: int) -> DataFrame:
    """Adds `rank` (1-based, seeded order inside the stratum) and `stratum_rows`."""
    keyed = frame.select("*", F.lit(1).cast("bigint").alias("_one"), hash_order(F.col(row_id), seed).alias("_order"))
    keyed = keyed.withColumn("_digit", hash_digit(F.col("_order")))
    summed = running_totals(keyed, [stratum], ["_digit"], [F.col("_order"), F.col(row_id)], ["_one"])
    return summed.select(*frame.columns, F.col("cum__one").alias("rank"), F.col("total__one").alias("stratum_rows"))


def allocate_quotas(frame: DataFrame, quotas: DataFrame, stratum: str, row_id: str, seed: int = 42) -> DataFrame:
    """Gives each stratum the exact number of rows per category.

    `quotas` is (stratum, category, count), of any size; a null stratum is a stratum like others.
    Rows beyond the sum of a stratum's quotas get a null category.
    """
    upto = Window.partitionBy(stratum).orderBy("category").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = quotas.withColumn("_to", F.sum("count").over(upto)).select(
        stratum, "category", (F.col("_to") - F.col("count")).alias("_from"), "_to"
    )
    wanted = ranges.withColumnRenamed(stratum, "_stratum")
    inside = [F.col(stratum).eqNullSafe(F.col("_stratum")), F.col("rank") > F.col("_from"), F.col("rank") <= F.col("_to")]
    found = ranked(frame, stratum, row_id, seed).join(wanted, inside, "left")
    return found.drop("_stratum", "_from", "_to", "stratum_rows")


def fixed_size_groups(
    frame: DataFrame, stratum: str, row_id: str, size: int = 6, seed: int = 42, bounds: tuple[int, int] | None = None
) -> DataFrame:
    """Chunks each stratum into groups of about `size`, sizes differing by at most one.

    Group count is the half-even rounding of rows/size, at least one; the first groups take the remainder. With `bounds`
    the job fails at a stratum whose groups would be smaller or larger.
    """
    placed = ranked(frame, stratum, row_id, seed)
    chunks = F.greatest(F.lit(1), F.bround(F.col("stratum_rows") / F.lit(size)).cast("bigint"))
    base = F.floor(F.col("stratum_rows") / chunks)
    extra = F.col("stratum_rows") % chunks
    if bounds is not None:
        fits = (base >= bounds[0]) & (base + (extra > 0).cast("bigint") <= bounds[1])
        message = F.format_string(f"A stratum of %d rows has no groups of {bounds[0]} to {bounds[1]} rows.", F.col("stratum_rows"))
        placed = placed.where(F.when(fits, True).otherwise(F.raise_error(message).cast("boolean")))
    place = F.col("rank") - 1
    border = extra * (base + 1)
    chunk = F.when(place < border, F.floor(place / (base + 1))).otherwise(extra + F.floor((place - border) / base))
    return placed.withColumn("chunk", chunk.cast("bigint") + 1).drop("stratum_rows")
