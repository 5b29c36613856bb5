"""Queries over thresholds, curves, fusion, evidence, models and explanations."""

from pyspark.sql import functions as F

from logtide.operators import audit, explain, lexical, scoring, units
from logtide.operators.skew import sized_lookup
from logtide.plans import views as V
from logtide.plans.catalog import register
from logtide.plans.catalog_joins import _ALIGNED_SQL, aligned_scores
from logtide.runtime import stored

_KEY = ["model_id"]


def score_curve(spark, d):
    return scoring.pr_curve(scoring.score_histogram(V.scores(spark, d), _KEY), _KEY)


def evidence_rows(spark, d):
    """Evidence of both pseudo-models at their best thresholds."""
    best = stored(scoring.best_thresholds(score_curve(spark, d), _KEY), "thresholds")
    rows = sized_lookup(V.scores(spark, d), best.withColumnRenamed("threshold", "limit"), "model_id", "inner")
    return scoring.evidence(rows, F.col("limit")).drop("limit", "validation_f1")


@register(f"WITH {V.SCORES} SELECT model_id, threshold, tp, flagged, round(\"precision\", 6) AS \"precision\", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pr")
def precision_recall_curve(spark, d):
    curve = score_curve(spark, d)
    return curve.select("model_id", "threshold", F.col("tp").cast("bigint").alias("tp"), F.col("flagged").cast("bigint").alias("flagged"),
                        *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@register(f"WITH {V.SCORES} SELECT model_id, threshold, round(validation_f1, 6) AS validation_f1 FROM best")
def best_f1_threshold(spark, d):
    return scoring.best_thresholds(score_curve(spark, d), _KEY).withColumn("validation_f1", F.round("validation_f1", 6))


@register(
    f"""WITH {V.SCORES} SELECT model_id, round(sum((n - pos) * ((tp - pos) + pos / CAST(2 AS DOUBLE))) / (max(total_pos) * (max(total_n) - max(total_pos))), 6) AS roc_auc,
    round(sum(pos * "precision") / max(total_pos), 6) AS pr_auc FROM pr GROUP BY 1"""
)
def roc_and_pr_area(spark, d):
    ranks = scoring.ranking_metrics(score_curve(spark, d), _KEY)
    return ranks.select("model_id", F.round("roc_auc", 6).alias("roc_auc"), F.round("pr_auc", 6).alias("pr_auc"))


_COUNTS = f"""{V.SCORES}, cm AS (SELECT model_id, count(*) FILTER (outcome = 'TN') AS tn, count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'FN') AS fn,
 count(*) FILTER (outcome = 'TP') AS tp, count(*) AS test_count FROM ev GROUP BY 1), mx AS (
 SELECT *, (tp + tn) / CAST(test_count AS DOUBLE) AS accuracy, coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS "precision", coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) AS recall,
  coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0) AS f1, coalesce(fp / CAST(nullif(fp + tn, 0) AS DOUBLE), 0) AS fpr FROM cm)"""


@register(f"WITH {_COUNTS} SELECT model_id, tn, fp, fn, tp, test_count FROM mx")
def confusion_counts(spark, d):
    return scoring.confusion(evidence_rows(spark, d), _KEY)


@register(
    f"WITH {_COUNTS} SELECT model_id, " + ", ".join(f'round("{c}", 6) AS "{c}"' for c in ("accuracy", "precision", "recall", "f1", "fpr")) + ", concat(tn, ',', fp, ',', fn, ',', tp) AS matrix FROM mx"
)
def confusion_metrics(spark, d):
    rows = scoring.confusion_metrics(scoring.confusion(evidence_rows(spark, d), _KEY))
    matrix = F.array_join(F.flatten("confusion_matrix").cast("array<string>"), ",")
    return rows.select("model_id", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "fpr")], matrix.alias("matrix"))


def metrics_rows(spark, d):
    """One metrics row per pseudo-model, with its order in the experiment."""
    counts = scoring.confusion_metrics(scoring.confusion(evidence_rows(spark, d), _KEY))
    curve = score_curve(spark, d)
    rows = counts.join(scoring.best_thresholds(curve, _KEY), "model_id").join(scoring.ranking_metrics(curve, _KEY), "model_id")
    order = F.when(F.col("model_id") == V.MODELS[0], 1).otherwise(2)
    return rows.withColumn("model_order", order)


@register(
    f"WITH {V.SCORES} SELECT model_id, unit_id, score, actual, threshold, predicted, round(confidence, 6) AS confidence, outcome FROM ev"
)
def prediction_evidence(spark, d):
    rows = evidence_rows(spark, d)
    return rows.select("model_id", "unit_id", "score", "actual", "threshold", "predicted", F.round("confidence", 6).alias("confidence"), "outcome")


@register(
    f"""WITH {V.SCORES} SELECT model_id, unit_id, CASE WHEN unit_id % 2 = 0 THEN outcome END AS outcome, predicted FROM ev"""
)
def outcomes_with_unknown_truth(spark, d):
    hidden = V.scores(spark, d).withColumn("actual", F.when(F.col("unit_id") % 2 == 0, F.col("actual")))
    best = stored(scoring.best_thresholds(score_curve(spark, d), _KEY), "thresholds").withColumnRenamed("threshold", "limit")
    rows = scoring.evidence(sized_lookup(hidden, best, "model_id", "inner"), F.col("limit"))
    return rows.select("model_id", "unit_id", "outcome", "predicted")


_FUSION = f"""{V.SCORES}, {_ALIGNED_SQL}, grid AS (SELECT i, actual, round(i * CAST(0.05 AS DOUBLE) * first + (1 - i * CAST(0.05 AS DOUBLE)) * second, 9) AS score FROM aligned, (SELECT unnest(range(0, 21)) AS i)),
 gh AS (SELECT i, score, sum(actual) AS pos, count(*) AS n FROM grid GROUP BY ALL), gc AS (
 SELECT i, score, sum(pos) OVER w AS tp, sum(n) OVER w AS fl, sum(pos) OVER (PARTITION BY i) AS p FROM gh WINDOW w AS (PARTITION BY i ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
 gf AS (SELECT i, score, round(2 * (tp / CAST(fl AS DOUBLE)) * (tp / CAST(p AS DOUBLE)) / (tp / CAST(fl AS DOUBLE) + tp / CAST(p AS DOUBLE) + CAST(1e-12 AS DOUBLE)), 9) AS f1 FROM gc)"""


@register(
    f"WITH {_FUSION} SELECT round(i * CAST(0.05 AS DOUBLE), 2) AS alpha, round(score, 6) AS threshold, round(f1, 6) AS validation_f1 FROM gf ORDER BY f1 DESC, i, score LIMIT 1"
)
def fusion_search(spark, d):
    best = scoring.best_fusion(aligned_scores(spark, d))
    return best.select(F.round("alpha", 2).alias("alpha"), F.round("threshold", 6).alias("threshold"), F.round("validation_f1", 6).alias("validation_f1"))


@register(
    f"WITH {V.SCORES}, {_ALIGNED_SQL} SELECT unit_id, actual, round(CAST(0.35 AS DOUBLE) * first + (1 - CAST(0.35 AS DOUBLE)) * second, 9) AS score FROM aligned"
)
def fused_scoring(spark, d):
    return aligned_scores(spark, d).select("unit_id", "actual", F.round(scoring.fuse(F.lit(0.35)), 9).alias("score"))


@register(f"WITH {V.SCORES} SELECT model_id AS recommended_model_id, round(validation_f1, 6) AS validation_f1 FROM best ORDER BY validation_f1 DESC, model_id LIMIT 1")
def recommended_model(spark, d):
    return scoring.recommended(metrics_rows(spark, d)).withColumn("validation_f1", F.round("validation_f1", 6))


@register(
    f"""WITH {V.PREPARED}, c AS (SELECT _target, count(*) AS n FROM prep WHERE _split = 'train' GROUP BY 1)
    SELECT _target, round((SELECT sum(n) FROM c) / CAST(2 * n AS DOUBLE), 6) AS weight, n AS "rows" FROM c"""
)
def balanced_class_weights(spark, d):
    from logtide.plans.experiment import balanced_weights

    train = V.prepared_logs(spark, d).where(F.col("_split") == "train")
    rows = train.select("_target", balanced_weights(train).alias("weight"))
    return rows.groupBy("_target").agg(F.round(F.max("weight"), 6).alias("weight"), F.count(F.lit(1)).alias("rows"))


def _neutral_sessions(spark, d):
    """Session-labelled logs whose texts do not name the event kind, so that the label must be learnt."""
    frame = V.session_logs(spark, d)
    plain = F.regexp_replace("_text", r"\b(click|error|purchase|signup|view)\b ?", "")
    return stored(frame.withColumn("_text", plain), "neutral-logs")


@register()
def logistic_regression_scores(spark, d):
    """TF-IDF with balanced logistic regression on labelled documents: held-out probabilities."""
    return _trained_evidence(spark, d, "tfidf", "lr")


@register()
def random_forest_scores(spark, d):
    """TF-IDF with a class-balanced forest on labelled documents: held-out probabilities."""
    return _trained_evidence(spark, d, "tfidf", "rf")


def _trained_evidence(spark, d, representation, clf):
    from logtide.plans.experiment import Settings, train_experiment

    labelled = V.document_logs(spark, d, "quality").where("_target is not null").withColumn("_session", F.lit(""))
    bundle = train_experiment(stored(labelled, "labelled"), Settings(representation=representation, classifier=clf))
    return bundle.evidence.select("model_id", "unit_id", "score", "predicted", "confidence", "threshold", "actual", "outcome")


@register()
def log_experiment_matrix(spark, d):
    """All five representations with both classifiers on logs: one metrics row each."""
    from logtide.plans.experiment import Settings, train_experiment

    frame = _neutral_sessions(spark, d)
    return train_experiment(frame, Settings()).metrics.drop("confusion_matrix")


@register()
def session_experiment_matrix(spark, d):
    """All five representations with both classifiers on sessions: one metrics row each."""
    from logtide.plans.experiment import Settings, train_experiment

    frame = _neutral_sessions(spark, d)
    return train_experiment(frame, Settings(group="sessions")).metrics.drop("confusion_matrix")


@register()
def saved_bundle_scoring(spark, d):
    """A trained run saved, loaded again and applied to every log by every model."""
    from logtide.plans.experiment import Bundle, Settings, predict, train_experiment
    from logtide.runtime import new_path

    frame = _neutral_sessions(spark, d)
    bundle = train_experiment(frame, Settings())
    path = new_path(spark, "bundle")
    bundle.save(path, spark)
    rows = predict(Bundle.load(path, spark), frame)
    return rows.select("model_id", "unit_id", "score", "prediction", "actual", "outcome", "representation", "classifier")


_PSEUDO = "(CAST((length(term) * 37 + tf * 11 + df * 5) % 101 AS DOUBLE) - 50) / 50"


@register(
    f"""WITH {V.CHATS}, {V.lexicon_sql('chats', 25000)}, entries AS (
    SELECT t.unit_id, t.term, (1 + ln(count(*))) * any_value(l.idf) AS w, any_value((CAST((length(l.term) * 37 + l.tf * 11 + l.df * 5) % 101 AS DOUBLE) - 50) / 50) AS coefficient
    FROM terms t JOIN lex l ON t.term = l.term GROUP BY 1, 2), norm AS (SELECT unit_id, sqrt(sum(w * w)) AS n FROM entries GROUP BY 1), top AS (
    SELECT e.unit_id, e.term, round(e.w / n.n * coefficient, 6) AS contribution, round(abs(e.w / n.n * coefficient), 12) AS size FROM entries e JOIN norm n ON e.unit_id = n.unit_id), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY size DESC, term) AS place FROM top)
    SELECT unit_id, CAST(count(*) AS BIGINT) AS terms, round(sum(abs(contribution)), 3) AS strength FROM ranked WHERE place <= 6 GROUP BY 1"""
)
def linear_explanations(spark, d):
    """Top six signed contributions per session under coefficients from integer arithmetic."""
    built = V.chat_sessions(spark, d)
    lexicon = lexical.fit_lexicon(built.where(F.col("_split") == "train"), lexical.SESSION_FEATURES)
    coefficients = [
        ((len(t) * 37 + tf * 11 + df * 5) % 101 - 50) / 50 for t, tf, df in zip(lexicon.terms, lexicon.tf, lexicon.df)
    ]
    found = explain.linear_contributions(lexical.tfidf_vectors(built, lexicon), lexicon, coefficients)
    size = F.aggregate("terms", F.lit(0.0), lambda a, e: a + F.abs(e["contribution"]))
    return found.where(F.size("terms") > 0).select(
        "unit_id", F.size("terms").cast("bigint").alias("terms"), F.round(size, 3).alias("strength")
    )


@register(
    f"""WITH {V.CHATS}, t AS (SELECT row_id AS unit_id, string_split(_text, ' ') AS toks FROM chat WHERE _text <> ''), full_score AS (
    SELECT unit_id, toks, list_sum(list_transform(toks, lambda x: length(x))) AS s, [x for x, i in toks if list_position(toks, x) = i] AS uniq FROM t), v AS (
    SELECT unit_id, toks, unnest(uniq[1:24]) AS term, unnest(range(1, len(uniq[1:24]) + 1)) AS place FROM full_score), change AS (
    SELECT unit_id, term, place, list_sum(list_transform(list_filter(toks, lambda x: x = term), lambda x: length(x))) AS contribution FROM v), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY contribution DESC, place) AS r FROM change)
    SELECT unit_id, string_agg(concat(term, '=', CAST(contribution AS BIGINT)), ' ' ORDER BY r) AS terms FROM ranked WHERE r <= 6 GROUP BY 1"""
)
def token_removal_sensitivity(spark, d):
    """Removal variants under a score that is the summed token length."""
    chats = V.chat_rows(spark, d).where("_text <> ''").select(F.col("row_id").alias("unit_id"), "_text")

    def score(variants):
        return variants.withColumn("score", F.length(F.replace(F.col("_text"), F.lit(" "), F.lit(""))).cast("double"))

    found = explain.removal_sensitivity(chats, score)
    shown = F.transform("terms", lambda e: F.concat(e["term"], F.lit("="), e["contribution"].cast("bigint").cast("string")))
    return found.select("unit_id", F.array_join(shown, " ").alias("terms"))


@register(
    f"""WITH {V.SCORES} SELECT model_id, unit_id, concat('The log was classified as ', CASE WHEN predicted = 1 THEN 'anomalous' ELSE 'normal' END,
    ' because its anomaly score (', printf('%.4f', score), ') is ', CASE WHEN predicted = 1 THEN 'above' ELSE 'below' END,
    ' the model decision threshold (', printf('%.4f', threshold), '). The strongest local model signals were kind (',
    printf('%+.4f', score - threshold), '), user (', printf('%+.4f', threshold - score), ').') AS explainability FROM ev"""
)
def english_explanations(spark, d):
    gap = F.col("score") - F.col("threshold")
    terms = F.array(
        F.struct(F.lit("kind").alias("term"), gap.alias("contribution")),
        F.struct(F.lit("user").alias("term"), (F.col("threshold") - F.col("score")).alias("contribution")),
    )
    rows = evidence_rows(spark, d)
    told = explain.sentence(F.col("predicted"), F.col("score"), F.col("threshold"), terms)
    return rows.select("model_id", "unit_id", told.alias("explainability"))
