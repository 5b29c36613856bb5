"""Thresholds, curves, fusion and evidence from score tables.

A score table is (model_id, unit_id, score, actual). Curves work on its histogram: one row per
distinct score, so equal scores collapse before the shuffle and the running sums never need a
single task for a whole model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.functions import labels as L
from logtide.operators.audit import total
from logtide.operators.skew import running_totals, score_digits

# --- fixed values ---------------------------------------------------------------------------
F1_GUARD = 1e-12
FUSION_STEPS = 20
FUSION_STEP = 0.05
# -------------------------------------------------------------------------------------------


def score_histogram(scores: DataFrame, keys: list[str], score: str = "score", actual: str = "actual") -> DataFrame:
    return scores.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(F.col(actual).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n")
    )


def pr_curve(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """Per distinct score: `tp` and `flagged` counts at score >= threshold, precision, recall and F1."""
    exponent, mantissa = score_digits(F.col("score"))
    cells = histogram.withColumn("_d0", -exponent).withColumn("_d1", -mantissa)
    summed = running_totals(cells, keys, ["_d0", "_d1"], [F.desc("score")], ["pos", "n"])
    precision = F.col("cum_pos") / F.col("cum_n")
    recall = F.try_divide(F.col("cum_pos").cast("double"), F.col("total_pos"))
    curve = summed.select(
        *keys,
        F.col("score").alias("threshold"),
        "pos",
        "n",
        F.col("cum_pos").alias("tp"),
        F.col("cum_n").alias("flagged"),
        "total_pos",
        "total_n",
        precision.alias("precision"),
        recall.alias("recall"),
    )
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F1_GUARD)
    return curve.withColumn("f1", f1)


def best_thresholds(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Threshold of the highest F1 per model; the lowest one on ties."""
    best = F.max_by(F.struct("threshold", "f1"), F.struct(F.col("f1"), -F.col("threshold")))
    return curve.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.col("_b.threshold").alias("threshold"), F.col("_b.f1").alias("validation_f1")
    )


def ranking_metrics(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Tie-aware ROC-AUC (null for one class) and average precision (null without positives)."""
    above = F.col("tp") - F.col("pos")
    negatives = F.col("n") - F.col("pos")
    wins = F.sum(negatives * (above + F.col("pos") / F.lit(2.0)))
    steps = F.sum(F.col("pos") * F.col("precision"))
    positive, everything = F.max("total_pos"), F.max("total_n")
    return curve.groupBy(*keys).agg(
        F.try_divide(wins, positive.cast("double") * (everything - positive)).alias("roc_auc"),
        F.try_divide(steps, positive.cast("double")).alias("pr_auc"),
    )


def fused_scores(first: DataFrame, second: DataFrame) -> DataFrame:
    """Aligns two models' scores by unit: (unit_id, actual, first, second)."""
    return first.select("unit_id", "actual", F.col("score").alias("first")).join(
        second.select("unit_id", F.col("score").alias("second")), "unit_id"
    )


def fusion_grid(aligned: DataFrame) -> DataFrame:
    """Each aligned row once per fusion weight 0, 0.05 .. 1, as an explode inside the row."""
    steps = F.sequence(F.lit(0), F.lit(FUSION_STEPS))
    alpha = F.col("step") * F.lit(FUSION_STEP)
    return aligned.select("*", F.explode(steps).alias("step")).select(
        "unit_id", "actual", alpha.alias("alpha"), fuse(alpha).alias("score")
    )


def fuse(alpha: Column) -> Column:
    return alpha * F.col("first") + (1 - alpha) * F.col("second")


def best_fusion(aligned: DataFrame) -> DataFrame:
    """(alpha, threshold, validation_f1): highest F1, smallest weight on ties, then lowest threshold."""
    grid = fusion_grid(aligned)
    tuned = best_thresholds(pr_curve(score_histogram(grid, ["alpha"]), ["alpha"]), ["alpha"])
    best = F.max_by(F.struct("alpha", "threshold", "validation_f1"), F.struct(F.col("validation_f1"), -F.col("alpha")))
    return tuned.agg(best.alias("b")).select("b.*")


def evidence(scored: DataFrame, threshold: Column) -> DataFrame:
    """Adds predicted, confidence, threshold and outcome to rows with `score` and `actual`."""
    prediction = L.predicted(F.col("score"), threshold)
    rows = scored.withColumn("predicted", prediction).withColumn("threshold", threshold.cast("double"))
    return rows.withColumn("confidence", L.confidence(F.col("score"), F.col("predicted"))).withColumn(
        "outcome", L.outcome(F.col("actual"), F.col("predicted"))
    )


def confusion(rows: DataFrame, keys: list[str]) -> DataFrame:
    """tn, fp, fn, tp and the row count per model."""
    return rows.groupBy(*keys).agg(
        *[total(F.col("outcome") == name).alias(name.lower()) for name in ("TN", "FP", "FN", "TP")],
        F.count(F.lit(1)).alias("test_count"),
    )


def confusion_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and false-positive rate; 0 where undefined."""

    def share(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top.cast("double"), bottom), F.lit(0.0))

    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.select(
        "*",
        share(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"),
        share(fp, fp + tn).alias("fpr"),
        F.array(F.array(tn, fp), F.array(fn, tp)).alias("confusion_matrix"),
    )


def recommended(metrics: DataFrame, order: str = "model_order") -> DataFrame:
    """The configuration with the highest validation F1, the first one on ties."""
    best = F.max_by("model_id", F.struct(F.col("validation_f1"), -F.col(order)))
    return metrics.agg(best.alias("recommended_model_id"), F.max("validation_f1").alias("validation_f1"))


def leaderboard_marks(metrics: DataFrame, columns: list[str], group: str) -> DataFrame:
    """Long (group, model_id, metric, value, best): the best value per metric, ties marked, FPR minimised.

    A leaderboard holds one row per configuration.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    long = metrics.select(group, "model_id", F.explode(entries).alias("e")).select(group, "model_id", "e.*")
    window = Window.partitionBy(group, "metric")
    target = F.when(F.col("metric") == "fpr", F.min("value").over(window)).otherwise(F.max("value").over(window))
    return long.withColumn("best", F.abs(F.col("value") - target) < 1e-12)
