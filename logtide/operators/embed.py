"""Word and event-key embeddings, their plain and IDF-weighted means, and scaling."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.functions import text as T
from logtide.operators.lexical import count_vectors
from logtide.operators.skew import key_sizes, salted_lookup, sized_lookup
from logtide.operators.units import Units, whole_sessions
from logtide.runtime import stored


# Numbers of a vector table that may be held on the driver and broadcast: 32 MB as doubles.
HELD_NUMBERS = 4_000_000


@dataclass(frozen=True)
class WordVectors:
    """Vectors of a vocabulary of proven size, held as one matrix."""

    words: tuple[str, ...]
    matrix: np.ndarray

    @property
    def size(self) -> int:
        return self.matrix.shape[1]


@dataclass(frozen=True)
class WordTable:
    """Fitted vectors as a table (word, vector, weight) of `rows` rows; a null weight leaves a word out of weighted means."""

    frame: DataFrame
    size: int
    rows: int

    @cached_property
    def held(self) -> tuple[WordVectors, dict[str, float]] | None:
        """Matrix and weights, if they are small enough to be broadcast."""
        if self.rows * self.size > HELD_NUMBERS:
            return None
        rows = sorted(self.frame.collect(), key=lambda row: row["word"])
        matrix = np.array([row["vector"] for row in rows]).reshape(len(rows), self.size)
        weights = {row["word"]: row["weight"] for row in rows if row["weight"] is not None}
        return WordVectors(tuple(row["word"] for row in rows), matrix), weights


def skip_gram_vectors(tokens: DataFrame, size: int, epochs: int, min_count: int, seed: int, window: int = 5, partitions: int = 1) -> DataFrame:
    """(word, vector) by Spark's Word2Vec over an array column `tokens`.

    The estimator keeps its vocabulary on the driver and repeats exactly with one partition only; `factor.word_vectors`
    has neither limit.
    """
    estimator = Word2Vec(
        vectorSize=size, windowSize=window, minCount=min_count, maxIter=epochs, seed=seed,
        numPartitions=partitions, inputCol="tokens", outputCol="_vector",
    )
    return estimator.fit(tokens.select("tokens")).getVectors().select("word", vector_to_array("vector").alias("vector"))


def word_table(vectors: DataFrame, weights: DataFrame, size: int) -> WordTable:
    """Puts (word, weight) rows beside (word, vector) rows, each with one row per word."""
    joined = stored(vectors.join(weights, "word", "left").select("word", "vector", "weight"), "word-table")
    return WordTable(joined, size, joined.count())


def untrained(word: str, size: int) -> np.ndarray:
    """The vector of a word that no training text holds: small, and the same wherever it is made."""
    seed = int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "big")
    return np.random.default_rng(seed).uniform(-0.5, 0.5, size) / size


def with_words(vectors: DataFrame, words: DataFrame, size: int) -> DataFrame:
    """Adds words that the fit did not see, each with its untrained vector."""

    @F.pandas_udf("array<double>")
    def fresh(new: pd.Series) -> pd.Series:
        return pd.Series([untrained(word, size) for word in new])

    new = words.select("word").distinct().join(vectors, "word", "left_anti")
    return vectors.select("word", "vector").unionByName(new.select("word", fresh("word").alias("vector")))


UNKNOWN = "<unk>"


def mean_vectors(
    frame: DataFrame,
    tokens: Column,
    vectors: WordVectors,
    outputs: Mapping[str, Mapping[str, float] | None],
    default_weight: float | None = None,
    count_unknown: bool = False,
) -> DataFrame:
    """Adds, per output name, the weighted mean vector of the known tokens and its total weight.

    An output's weights map words to weights (None: every occurrence counts 1); a known word
    without a weight takes `default_weight`, or is left out when that is None. With
    `count_unknown`, every other token counts as one and the same unknown word of that weight.
    Token counts are built by JVM expressions in the row itself; the one Arrow step is a small
    matrix product. Texts without any usable token get zeros. Nothing is shuffled.
    """
    if not vectors.words:
        raise ValueError("The embedding has no words.")
    counted = count_vectors(frame.withColumn("_tokens", tokens), "_tokens", list(vectors.words), "_counts")
    parts = F.unwrap_udt(F.col("_counts"))
    counted = counted.withColumn("_i", parts["indices"]).withColumn("_n", parts["values"])
    spare = F.size("_tokens") - F.aggregate("_n", F.lit(0.0), lambda total, n: total + n) if count_unknown else F.lit(0.0)
    counted = counted.withColumn("_u", spare.cast("double"))
    spark = frame.sparkSession
    for name, weights in outputs.items():
        if weights is None:
            per_word = np.ones(len(vectors.words))
        else:
            missing = 0.0 if default_weight is None else default_weight
            per_word = np.array([weights.get(word, missing) for word in vectors.words])
        # The unknown word is the last row; a text without unknown words holds it zero times.
        rows = np.vstack([vectors.matrix, untrained(UNKNOWN, vectors.size)])
        shared = spark.sparkContext.broadcast((rows, np.append(per_word, 1.0 if weights is None else default_weight or 0.0)))

        @F.pandas_udf("struct<vector:array<double>,weight:double>")
        def averaged(indices: pd.Series, counts: pd.Series, spare: pd.Series) -> pd.DataFrame:
            matrix, word_weights = shared.value
            sizes = indices.map(len).to_numpy()
            starts = np.concatenate([[0], np.cumsum(sizes + 1)])
            places, times = np.full(starts[-1], len(matrix) - 1), np.empty(starts[-1])
            last = starts[1:] - 1
            times[last] = spare
            inner = np.ones(starts[-1], dtype=bool)
            inner[last] = False
            if sizes.sum():
                places[inner], times[inner] = np.concatenate(indices.to_list()), np.concatenate(counts.to_list())
            weight = times * word_weights[places]
            totals = np.add.reduceat(weight, starts[:-1]) if len(sizes) else np.zeros(0)
            sums = np.zeros((len(sizes), matrix.shape[1]))
            for begin in range(0, len(sizes), 512):
                end = min(begin + 512, len(sizes))
                part = slice(starts[begin], starts[end])
                sums[begin:end] = np.add.reduceat(weight[part, None] * matrix[places[part]], starts[begin:end] - starts[begin], axis=0)
            means = sums / np.where(totals > 0, totals, 1.0)[:, None] * (totals > 0)[:, None]
            return pd.DataFrame({"vector": list(means), "weight": totals})

        counted = counted.withColumn("_m", averaged("_i", "_n", "_u"))
        counted = counted.withColumn(name, F.col("_m.vector")).withColumn(f"{name}_weight", F.col("_m.weight")).drop("_m")
    return counted.drop("_tokens", "_counts", "_i", "_n", "_u")


def _joined_means(frame: DataFrame, key: str, tokens: Column, table: WordTable, default_weight: float | None = None) -> DataFrame:
    """(key, mean, weighted) for every value of `key`: the tokens are joined to the table, whatever its size.

    With a default weight unknown tokens count as the unknown word of that weight, else they are left out.
    """
    counted = frame.select(key, F.explode(tokens).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    found = salted_lookup(counted, table.frame, "word", "inner" if default_weight is None else "left")
    if default_weight is not None:
        unknown = F.array(*[F.lit(float(x)) for x in untrained(UNKNOWN, table.size)])
        found = found.withColumn("vector", F.coalesce("vector", unknown)).withColumn("weight", F.coalesce("weight", F.lit(default_weight)))
    found = stored(found.select(key, "vector", "_n", (F.col("_n") * F.col("weight")).alias("_w")), "found-tokens")
    zeros = F.array(*[F.lit(0.0)] * table.size)
    result = frame.select(key).distinct()
    for name, weight in (("mean", "_n"), ("weighted", "_w")):
        # The summarizer refuses a group whose weights are all zero.
        means = found.where(F.col(weight) > 0).groupBy(key).agg(Summarizer.mean(array_to_vector("vector"), F.col(weight)).alias("_m"))
        result = result.join(means.select(key, vector_to_array("_m").alias(name)), key, "left")
    return result.select(key, F.coalesce("mean", zeros).alias("mean"), F.coalesce("weighted", zeros).alias("weighted"))


def _held(texts: DataFrame, numbers: int) -> bool:
    """Whether texts with so many numbers each may be broadcast."""
    found = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("bytes")).first()
    return found["n"] * numbers <= HELD_NUMBERS and found["bytes"] <= 8 * HELD_NUMBERS


def text_embeddings(units: Units, table: WordTable) -> DataFrame:
    """Unit rows with `mean` and `weighted` arrays. Each distinct text is embedded once."""
    distinct = stored(key_sizes(units.frame, "_text"), "texts")
    tokens = T.whitespace_tokens(F.col("_text"))
    if table.held is None:
        lookup = _joined_means(distinct, "_text", tokens, table)
    else:
        vectors, idf = table.held
        embedded = mean_vectors(distinct.select("_text"), tokens, vectors, {"mean": None, "weighted": idf})
        lookup = embedded.drop("mean_weight", "weighted_weight")
    if _held(distinct, 2 * table.size):
        # Few texts, each in many rows: a shuffle by text would bring all rows together in as few tasks.
        return units.frame.join(F.broadcast(lookup), "_text", "inner")
    return salted_lookup(units.frame, lookup, "_text", "inner", sizes=distinct)


def session_embeddings(units: Units, table: WordTable) -> DataFrame:
    """Session rows with `mean` and `weighted` key vectors; segments of long sessions are averaged by weight."""
    if table.held is None:
        unknown = table.frame.agg(F.max("weight")).first()[0]
        means = _joined_means(units.frame, "unit_id", F.col("log_keys"), table, 1.0 if unknown is None else unknown)
        return units.per_unit.join(means, "unit_id")
    vectors, idf = table.held
    unknown = max(idf.values()) if idf else 1.0
    outputs = {"mean": None, "weighted": idf}
    embedded = mean_vectors(units.frame, F.col("log_keys"), vectors, outputs, default_weight=unknown, count_unknown=True)
    if not units.segmented:
        return embedded.drop("mean_weight", "weighted_weight")
    base = embedded.drop("mean_weight", "weighted_weight")
    joined = whole_sessions(base.drop("mean", "weighted"))
    zeros = F.array(*[F.lit(0.0)] * vectors.size)
    for name in outputs:
        # The summarizer refuses a group whose weights are all zero, so such sessions stay out of it.
        known = embedded.where((F.col("segments") > 1) & (F.col(f"{name}_weight") > 0))
        means = known.groupBy("unit_id").agg(Summarizer.mean(array_to_vector(name), F.col(f"{name}_weight")).alias("_m"))
        joined = joined.join(means.select("unit_id", vector_to_array("_m").alias(name)), "unit_id", "left")
        joined = joined.withColumn(name, F.coalesce(name, zeros))
    return base.where("segments = 1").unionByName(joined)


def token_means(tokens: DataFrame, vectors: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(unit_id, mean, mean_weight) in long form: (unit_id, token) rows joined to (token, vector) and (token, weight).

    Occurrences are counted per unit and token before any join, lookups are broadcast only after
    a size check, and the average is taken by the ML summarizer.
    """
    counted = tokens.groupBy("unit_id", "token").agg(F.count(F.lit(1)).cast("double").alias("_w"))
    found = sized_lookup(counted, vectors, "token", "inner")
    if weights is not None:
        found = sized_lookup(found, weights, "token", "inner").withColumn("_w", F.col("_w") * F.col("weight"))
    averaged = found.where("_w > 0").groupBy("unit_id").agg(
        Summarizer.mean(array_to_vector("vector"), F.col("_w")).alias("_m"), F.sum("_w").alias("mean_weight")
    )
    return averaged.select("unit_id", vector_to_array("_m").alias("mean"), "mean_weight")


@dataclass(frozen=True)
class Scaling:
    mean: tuple[float, ...]
    deviation: tuple[float, ...]


def fit_scalings(frame: DataFrame, columns: Sequence[str]) -> list[Scaling]:
    """Mean and population deviation per dimension of each array column, from one pass.

    A zero deviation counts as one.
    """
    summaries = [
        Summarizer.metrics("mean", "std", "count").summary(array_to_vector(c)).alias(f"s{i}")
        for i, c in enumerate(columns)
    ]
    row = frame.agg(*summaries).select(
        *[F.col(f"s{i}.{m}").alias(f"{m}{i}") for i in range(len(columns)) for m in ("mean", "std", "count")]
    ).first()
    result = []
    for i in range(len(columns)):
        n = row[f"count{i}"]
        shrink = ((n - 1) / n) ** 0.5 if n else 0.0
        deviation = [float(v) * shrink for v in row[f"std{i}"]]
        result.append(Scaling(tuple(map(float, row[f"mean{i}"])), tuple(d if d > 0 else 1.0 for d in deviation)))
    return result


def scaled(column: Column, scaling: Scaling) -> Column:
    center = F.array(*[F.lit(v) for v in scaling.mean])
    spread = F.array(*[F.lit(v) for v in scaling.deviation])
    return F.zip_with(F.zip_with(column, center, lambda v, m: v - m), spread, lambda v, s: v / s)


def scaled_by_dimension(frame: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Long form of the scaling: (keys, dimension, value) with (value - mean) / population deviation."""
    long = frame.select(*keys, F.posexplode(column).alias("dimension", "v"))
    # One row per vector dimension.
    stats = long.groupBy("dimension").agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    spread = F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    joined = sized_lookup(long, stats, "dimension", "inner")
    return joined.select(*keys, "dimension", ((F.col("v") - F.col("_m")) / spread).alias("value"))


def centre_of(frame: DataFrame, column: str) -> list[float]:
    """Mean vector of the given rows."""
    return list(map(float, frame.select(Summarizer.mean(array_to_vector(column)).alias("m")).first()["m"]))


def squared_distance(column: Column, centre: list[float]) -> Column:
    """Mean squared deviation from a fixed vector."""
    fixed = F.array(*[F.lit(v) for v in centre])
    gaps = F.zip_with(column, fixed, lambda v, c: (v - c) * (v - c))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g) / F.lit(float(len(centre)))
