"""TF-IDF: vocabulary, smooth IDF and L2-normalised vectors."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as types

from logtide.functions import text as T
from logtide.operators.units import Units, whole_sessions

# --- fixed values ---------------------------------------------------------------------------
MIN_DOCUMENTS = 2
LOG_FEATURES = 20_000
SESSION_FEATURES = 25_000
# -------------------------------------------------------------------------------------------

_VECTOR = types.StructType([types.StructField("v", VectorUDT())])


def with_terms(frame: DataFrame) -> DataFrame:
    """Adds `_terms`, the unigrams and bigrams of a unit's text.

    A later segment starts with the separator that precedes it. Words are their own projection
    step, so that the tokeniser runs once per text however often the bigrams refer to it.
    """
    text = F.when(F.col("segment") > 0, F.concat(F.lit(T.EVENT_SEPARATOR), F.col("_text"))).otherwise(F.col("_text"))
    words = frame.withColumn("_words", T.word_tokens(text))
    chain = F.when(F.col("lead_token").isNotNull(), F.concat(F.array("lead_token"), "_words")).otherwise(F.col("_words"))
    chained = words.withColumn("_chain", chain)
    return chained.withColumn("_terms", F.concat("_words", T.bigrams(F.col("_chain")))).drop("_words", "_chain")


def term_frequencies(units: Units) -> DataFrame:
    """(term, tf, df) over the units from one exploded pass, combined before the shuffle."""
    terms = with_terms(units.frame).select("unit_id", "segments", F.col("_terms").alias("terms"))
    # Two lists per unit, all occurrences and distinct terms, each exploded with its own counters.
    lists = F.array(
        F.struct(F.lit(1).alias("tf"), F.lit(0).alias("df"), F.col("terms").alias("list")),
        F.struct(F.lit(0).alias("tf"), F.lit(1).alias("df"), F.array_distinct("terms").alias("list")),
    )
    single = terms.where("segments = 1") if units.segmented else terms
    # The outer forms keep the optimizer from inferring a size filter that would tokenise every text twice.
    pairs = single.select(F.explode_outer(lists).alias("e")).select(F.explode_outer("e.list").alias("term"), "e.tf", "e.df")
    pairs = pairs.where("term is not null")
    if units.segmented:
        # A term counts once per session, however many segments hold it.
        long = terms.where("segments > 1").select("unit_id", F.explode("terms").alias("term"))
        per_unit = long.groupBy("unit_id", "term").agg(F.count(F.lit(1)).alias("tf"))
        pairs = pairs.unionByName(per_unit.select("term", "tf", F.lit(1).alias("df")))
    return pairs.groupBy("term").agg(
        F.sum("tf").cast("bigint").alias("tf"), F.sum("df").cast("bigint").alias("df")
    )


def vocabulary(frequencies: DataFrame, max_features: int, min_df: int = MIN_DOCUMENTS) -> DataFrame:
    """Terms in at least `min_df` units, the most frequent `max_features` of them; ties by term."""
    return frequencies.where(F.col("df") >= min_df).orderBy(F.desc("tf"), "term").limit(max_features)


def smooth_idf(df: Column, documents: Column) -> Column:
    return F.log((1 + documents) / (1 + df)) + 1


@dataclass(frozen=True)
class Lexicon:
    """Fitted vocabulary: at most `max_features` terms in term order."""

    terms: tuple[str, ...]
    df: tuple[int, ...]
    tf: tuple[int, ...]
    documents: int

    @property
    def idf(self) -> list[float]:
        return [math.log((1 + self.documents) / (1 + df)) + 1 for df in self.df]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(range(len(self.terms)), self.terms, self.tf, self.df, self.idf))
        return spark.createDataFrame(rows, "index int, term string, tf bigint, df bigint, idf double")


def fit_lexicon(train: Units, max_features: int = LOG_FEATURES, min_df: int = MIN_DOCUMENTS) -> Lexicon:
    # The capped vocabulary (at most max_features rows) is the only thing that reaches the driver.
    rows = sorted(vocabulary(term_frequencies(train), max_features, min_df).collect(), key=lambda r: r["term"])
    if not rows:
        raise ValueError("No term appears in enough training units.")
    documents = train.heads.count()
    return Lexicon(
        tuple(r["term"] for r in rows), tuple(r["df"] for r in rows), tuple(r["tf"] for r in rows), documents
    )


def sparse_vector(indices: Column, values: Column, size: int) -> Column:
    """Sparse ML vector from two arrays, built by JVM expressions only."""
    parts = F.struct(
        F.lit(0).alias("type"), F.lit(size).alias("size"), indices.alias("indices"), values.alias("values")
    )
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), _VECTOR)["v"]


def count_vectors(frame: DataFrame, tokens: str, terms: list[str], output: str) -> DataFrame:
    """Adds the sparse term counts of a token column; narrow, the capped vocabulary rides along."""
    model = CountVectorizerModel.from_vocabulary(list(terms), inputCol=tokens, outputCol=output, minTF=1.0)
    return model.transform(frame)


def _whole_unit_counts(counted: DataFrame) -> DataFrame:
    """Adds the term counts (`_i`, `_v`) of long sessions up to one row per unit; single-segment units pass through."""
    entries = counted.where("segments > 1").select("unit_id", F.explode_outer(F.arrays_zip("_i", "_v")).alias("e"))
    entries = entries.where("e is not null")
    summed = entries.groupBy("unit_id", F.col("e._i").alias("i")).agg(F.sum("e._v").alias("v"))
    # At most as many entries per unit as the vocabulary has, which is capped.
    packed = summed.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("_e"))
    whole = packed.select("unit_id", F.col("_e.i").alias("_i"), F.col("_e.v").alias("_v"))
    long = whole_sessions(counted.drop("_i", "_v")).join(whole, "unit_id", "left")
    filled = long.withColumns({"_i": F.coalesce("_i", F.array().cast("array<int>")), "_v": F.coalesce("_v", F.array().cast("array<double>"))})
    return counted.where("segments = 1").unionByName(filled)


def term_weights(units: Units, lexicon: Lexicon) -> DataFrame:
    """Unit rows with `_i` and `_w`: numbers of their terms and the sublinear, IDF-weighted weights of unit length.

    Arrays in the row, without a shuffle for log units; no vector is built.
    """
    counted = count_vectors(with_terms(units.frame), "_terms", lexicon.terms, "_counts")
    parts = F.unwrap_udt(F.col("_counts"))
    arrays = counted.withColumns({"_i": parts["indices"], "_v": parts["values"]}).drop("_terms", "_counts")
    if units.segmented:
        arrays = _whole_unit_counts(arrays)
    # One constant, folded when the plan is made.
    idf = F.from_json(F.lit(json.dumps(lexicon.idf)), "array<double>")
    weighed = F.zip_with("_v", "_i", lambda v, i: (1 + F.log(v)) * F.get(idf, i))

    def unit_length(weights: Column) -> Column:
        # The length is bound once: named as a column of its own, it would be worked out again for each weight.
        length = F.sqrt(F.aggregate(weights, F.lit(0.0), lambda total, x: total + x * x))
        return F.transform(F.array(length), lambda n: F.transform(weights, lambda x: x / n))[0]

    bound = F.transform(F.array(weighed), unit_length)[0]
    return arrays.withColumn("_w", bound).drop("_v")


def tfidf_vectors(units: Units, lexicon: Lexicon, output: str = "tfidf") -> DataFrame:
    """Unit rows with the sublinear, IDF-weighted, L2-normalised vector. No shuffle for log units."""
    size = len(lexicon.terms)
    return term_weights(units, lexicon).withColumn(output, sparse_vector(F.col("_i"), F.col("_w"), size)).drop("_i", "_w")


def weight_entries(weights: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(unit_id, term, weight): `term_weights` one row per entry. The capped vocabulary is broadcast, nothing is shuffled."""
    zipped = F.arrays_zip(F.col("_i").alias("i"), F.col("_w").alias("v"))
    words = lexicon.table(weights.sparkSession).select("index", "term")
    # Outer: an inferred size filter would weigh every text twice. The inner join drops empty ones.
    entries = weights.select("unit_id", F.explode_outer(zipped).alias("e"))
    return entries.join(F.broadcast(words), F.col("e.i") == F.col("index")).select(
        "unit_id", "term", F.col("e.v").alias("weight")
    )


def key_idf(train: Units) -> DataFrame:
    """(key, df, idf) of event-template ids; keys are split at whitespace and keep their case."""
    tokens = F.flatten(F.transform("log_keys", T.whitespace_tokens))
    keys = train.frame.select("unit_id", F.explode(F.array_distinct(tokens)).alias("key"))
    if train.segmented:
        keys = keys.distinct()
    counted = keys.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    documents = train.heads.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counted.withColumn("idf", smooth_idf(F.col("df"), documents))
