"""Why a unit got its score: linear contributions, token removal and the sentence around them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.functions import text as T
from logtide.operators.lexical import Lexicon

# --- fixed values ---------------------------------------------------------------------------
MAX_TERMS = 6
MAX_REMOVED = 24
MAX_SIGNALS = 4
SESSION_NOTE = (
    " The selected session model evaluates the ordered event-template sequence as a whole, "
    "so individual words are not treated as causal evidence."
)
# -------------------------------------------------------------------------------------------


def strongest(entries: Column, limit: int = MAX_TERMS) -> Column:
    """The entries of largest absolute contribution, as (term, contribution); ties by term."""
    keyed = F.transform(
        entries,
        lambda e: F.struct(
            (-F.abs(e["contribution"])).alias("size"), e["term"].alias("term"), e["contribution"].alias("contribution")
        ),
    )
    top = F.slice(F.array_sort(keyed), 1, limit)
    return F.transform(top, lambda e: F.struct(e["term"].alias("term"), e["contribution"].alias("contribution")))


def linear_contributions(
    vectors: DataFrame, lexicon: Lexicon, coefficients: Sequence[float], column: str = "tfidf"
) -> DataFrame:
    """Adds `terms`: signed TF-IDF x coefficient of the strongest vocabulary terms.

    The product is taken on the sparse vector in the row; only six entries per unit are
    exploded to find their words in the capped vocabulary.
    """
    product = ElementwiseProduct(scalingVec=Vectors.dense(list(coefficients)), inputCol=column, outputCol="_p")
    parts = F.unwrap_udt(F.col("_p"))
    entries = F.zip_with(
        parts["indices"], parts["values"], lambda i, v: F.struct(i.alias("term"), v.alias("contribution"))
    )
    top = product.transform(vectors).withColumn("_top", strongest(entries)).drop("_p")
    words = lexicon.table(vectors.sparkSession).select("index", "term")
    named = (
        top.select("unit_id", F.posexplode_outer("_top").alias("_at", "e"))
        .join(F.broadcast(words), F.col("e.term") == F.col("index"))
        .groupBy("unit_id")
        .agg(F.array_sort(F.collect_list(F.struct("_at", "term", F.col("e.contribution").alias("contribution")))).alias("_t"))
    )
    terms = F.transform("_t", lambda e: F.struct(e["term"].alias("term"), e["contribution"].alias("contribution")))
    empty = F.array().cast("array<struct<term:string,contribution:double>>")
    joined = top.drop("_top").join(named.select("unit_id", terms.alias("terms")), "unit_id", "left")
    return joined.withColumn("terms", F.coalesce("terms", empty))


def removal_variants(texts: DataFrame, key: str = "unit_id") -> DataFrame:
    """(key, removed, place, _text): the full text (removed null) and one variant per distinct token.

    At most the first 24 distinct tokens are tried, so a row has at most 25 variants.
    """
    tokens = T.whitespace_tokens(F.col("_text"))
    tried = F.slice(F.array_distinct(F.col("_tokens")), 1, MAX_REMOVED)
    base = texts.select(key, "_text", tokens.alias("_tokens"))
    full = base.select(key, F.lit(None).cast("string").alias("removed"), F.lit(0).alias("place"), "_text")
    cut = base.select(key, "_tokens", F.posexplode(tried).alias("_at", "removed")).select(
        key,
        "removed",
        (F.col("_at") + 1).alias("place"),
        F.array_join(F.array_remove(F.col("_tokens"), F.col("removed")), " ").alias("_text"),
    )
    return full.unionByName(cut)


def removal_sensitivity(texts: DataFrame, score: Callable[[DataFrame], DataFrame], key: str = "unit_id") -> DataFrame:
    """(key, terms): score(full) - score(without the token), strongest six.

    `score` adds a `score` column; all variants of all rows are scored in one job.
    """
    scored = score(removal_variants(texts, key)).select(key, "removed", "place", "score")
    full = F.max(F.when(F.col("removed").isNull(), F.col("score")))
    # At most 25 rows per key.
    grouped = scored.groupBy(key).agg(
        full.alias("_full"), F.collect_list(F.struct("removed", "place", "score")).alias("_v")
    )
    changes = F.transform(
        F.filter("_v", lambda v: v["removed"].isNotNull()),
        lambda v: F.struct(
            (-F.abs(F.col("_full") - v["score"])).alias("size"),
            v["place"].alias("place"),
            v["removed"].alias("term"),
            (F.col("_full") - v["score"]).alias("contribution"),
        ),
    )
    top = F.slice(F.array_sort(changes), 1, MAX_TERMS)
    terms = F.transform(top, lambda e: F.struct(e["term"].alias("term"), e["contribution"].alias("contribution")))
    return grouped.select(key, terms.alias("terms"))


def sentence(predicted: Column, score: Column, threshold: Column, terms: Column | None, sessions: bool = False) -> Column:
    """One English sentence with direction, score, threshold and up to four signals."""
    direction = F.when(predicted == 1, "anomalous").otherwise("normal")
    relation = F.when(predicted == 1, "above").otherwise("below")
    base = F.format_string(
        "The log was classified as %s because its anomaly score (%.4f) is %s the model decision threshold (%.4f).",
        direction,
        score.cast("double"),
        relation,
        threshold.cast("double"),
    )
    if terms is not None:
        signals = F.transform(
            F.slice(terms, 1, MAX_SIGNALS), lambda e: F.format_string("%s (%+.4f)", e["term"], e["contribution"])
        )
        told = F.concat(F.lit(" The strongest local model signals were "), F.array_join(signals, ", "), F.lit("."))
        base = F.concat(base, F.when(F.size(terms) > 0, told).otherwise(""))
    return F.concat(base, F.lit(SESSION_NOTE)) if sessions else base
