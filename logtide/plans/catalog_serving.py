"""Queries over sorts, limits, pages, leaderboards, set operations and whole analyses."""

from pyspark.sql import functions as F

from logtide.functions import labels as L
from logtide.functions import text as T
from logtide.operators import audit, prepare, scoring, serve
from logtide.operators.skew import salted_lookup
from logtide.plans import views as V
from logtide.plans.catalog import register
from logtide.plans.catalog_scoring import _COUNTS, evidence_rows, metrics_rows
from logtide.runtime import stored


@register(
    f"""WITH {V.PREPARED} SELECT row_number() OVER (ORDER BY _timestamp, row_id) AS place, row_id FROM prep"""
)
def chronological_order(spark, d):
    from logtide.operators.skew import with_row_position

    rows = V.prepared_logs(spark, d).select("row_id", "_timestamp")
    return with_row_position(rows, [F.col("_timestamp"), F.col("row_id")], "place").select("place", "row_id")


@register(f"WITH {V.PREPARED} SELECT row_number() OVER (ORDER BY _timestamp, session_id, row_id) AS place, row_id, session_id FROM prep")
def two_key_sorted_head(spark, d):
    from logtide.operators.skew import with_row_position

    rows = V.prepared_logs(spark, d).select("row_id", "session_id", "_timestamp")
    order = [F.col("_timestamp"), F.col("session_id"), F.col("row_id")]
    return with_row_position(rows, order, "place").select("place", "row_id", "session_id")


@register(
    f"""WITH {V.PREPARED} SELECT row_id, "timestamp", network_function, severity, log_text, label, anomaly_type, scenario_id, session_id, template_id, split
    FROM prep WHERE _split = 'test' AND contains(lower(log_text), 'purchase') ORDER BY row_id LIMIT 100"""
)
def display_first_hundred(spark, d):
    return serve.browse(V.prepared_logs(spark, d), "test", "PURCHASE", "100")


@register(f"WITH {V.PREPARED} SELECT row_id, log_text FROM prep WHERE _split = 'validation' ORDER BY row_id LIMIT 20 OFFSET 40")
def page_slice(spark, d):
    rows = V.prepared_logs(spark, d).where(F.col("_split") == "validation").select("row_id", "log_text")
    visible, _ = serve.page(rows, 3, 20)
    return visible


@register("SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 8")
def head_rows(spark, d):
    return V.table(spark, d, "events").select("event_id", "event_type").orderBy("event_id").limit(8)


@register(
    f"""WITH {V.PREPARED} SELECT row_id, _split, _target FROM (SELECT *, row_number() OVER (PARTITION BY _split, _target ORDER BY row_id) AS r FROM prep) WHERE r <= 2"""
)
def head_per_group(spark, d):
    rows = V.prepared_logs(spark, d).select("row_id", "_split", "_target")
    return serve.head_per_group(rows, ["_split", "_target"], "row_id", 2)


@register(f"WITH {V.SCORES} SELECT model_id, unit_id, score, outcome FROM ev WHERE outcome = 'FP'")
def evidence_by_outcome(spark, d):
    return serve.by_outcome(evidence_rows(spark, d), "FP").select("model_id", "unit_id", "score", "outcome")


@register(
    f"""WITH {_COUNTS} SELECT model_id, round(accuracy, 4) AS accuracy, round("precision", 4) AS "precision", round(recall, 4) AS recall, round(f1, 4) AS f1, round(fpr, 4) AS fpr FROM mx"""
)
def leaderboard(spark, d):
    columns = ["model_id", "accuracy", "precision", "recall", "f1", "fpr"]
    return serve.leaderboard(metrics_rows(spark, d).select(*columns, "model_order")).select(*columns)


_LONG = " UNION ALL ".join(f"""SELECT model_id, '{c}' AS metric, "{c}" AS v FROM mx""" for c in ("accuracy", "f1", "fpr"))


@register(
    f"""WITH {_COUNTS}, l AS ({_LONG}) SELECT 'logs' AS "group", model_id, metric, round(v, 6) AS value,
    abs(v - CASE WHEN metric = 'fpr' THEN min(v) OVER (PARTITION BY metric) ELSE max(v) OVER (PARTITION BY metric) END) < CAST(1e-12 AS DOUBLE) AS best FROM l"""
)
def leaderboard_best_marks(spark, d):
    marked = scoring.leaderboard_marks(metrics_rows(spark, d).withColumn("group", F.lit("logs")), ["accuracy", "f1", "fpr"], "group")
    return marked.withColumn("value", F.round("value", 6))


def _runs(spark, d):
    """One run record per supplier nation, created in supplier order."""
    s = V.table(spark, d, "supplier")
    return s.select(
        F.concat(F.lit("run"), F.col("s_suppkey")).alias("id"), F.lit("completed").alias("status"),
        F.date_format(F.timestamp_seconds(F.col("s_suppkey") * 60), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        F.concat(F.lit("data"), F.col("s_nationkey")).alias("dataset_id"), F.col("s_name").alias("dataset_name"),
        F.concat(F.lit("logs__tfidf__"), F.when(F.col("s_acctbal") > 0, "lr").otherwise("rf")).alias("recommended_model_id"),
    )


_RUNS_SQL = """runs AS (SELECT concat('run', s_suppkey) AS id, 'completed' AS status, strftime(make_timestamp(s_suppkey * 60000000), '%Y-%m-%dT%H:%M:%S') AS created_at,
 concat('data', s_nationkey) AS dataset_id, s_name AS dataset_name, CASE WHEN s_acctbal > 0 THEN 'logs__tfidf__lr' ELSE 'logs__tfidf__rf' END AS recommended_model_id FROM supplier)"""


@register(f"WITH {_RUNS_SQL} SELECT * FROM runs")
def run_list(spark, d):
    return serve.run_list(_runs(spark, d))


@register(f"WITH {_RUNS_SQL} SELECT id, dataset_id, created_at FROM runs WHERE dataset_id = 'data3' ORDER BY created_at DESC, id DESC LIMIT 1")
def latest_analysis(spark, d):
    return serve.latest_analysis(_runs(spark, d).select("id", "dataset_id", "created_at"), "data3")


@register(
    f"""WITH {_COUNTS} SELECT model_id, 'run' AS source, round(f1, 6) AS f1, round(fpr, 6) AS fpr FROM mx
    UNION ALL SELECT replace(model_id, 'logs__', 'saved__'), 'saved', round(f1, 6), round(fpr, 6) FROM mx WHERE f1 > 0"""
)
def saved_and_new_results(spark, d):
    new = metrics_rows(spark, d).select("model_id", F.lit("run").alias("source"), F.round("f1", 6).alias("f1"), F.round("fpr", 6).alias("fpr"))
    saved = new.where("f1 > 0").select(F.regexp_replace("model_id", "^logs__", "saved__").alias("model_id"), F.lit("saved").alias("source"), "f1", "fpr")
    return new.unionByName(saved)


@register(
    f"""WITH {V.SCORES} SELECT model_id, date_trunc('hour', e.ts) AS time, CAST(sum(predicted) AS BIGINT) AS count FROM ev JOIN events e ON e.event_id + 1 = ev.unit_id GROUP BY ALL"""
)
def evidence_timeline(spark, d):
    from functools import reduce

    times = audit.unit_times(V.prepared_logs(spark, d), sessions=False).select(F.col("unit_id").cast("bigint").alias("unit_id"), F.col("unit_time").alias("_timestamp"))
    rows = evidence_rows(spark, d).join(times, "unit_id", "left")
    hour = F.date_trunc("hour", F.col("_timestamp")).cast("timestamp_ntz")
    return rows.where("_timestamp is not null").groupBy("model_id", hour.alias("time")).agg(F.sum(F.col("predicted").cast("bigint")).alias("count"))


@register()
def whole_dataset_analysis(spark, d):
    """A stored dataset trained, saved, scored again with explanations; the saved rows."""
    from logtide.plans.analysis import analyze, train_run
    from logtide.plans.experiment import Settings
    from logtide.runtime import new_path
    from logtide.sources.store import Store

    store = Store(spark, new_path(spark, "workspace"))
    labelled = V.raw_documents(spark, d, "quality").where("target is not null").select("row_id", "log_text", "target", "split")
    frame = prepare.prepared_frame(labelled, row_id="row_id")
    # Copies of one text may carry both labels in these tables; such texts are left out as an upload would be refused.
    bad = prepare.contradictory_texts(frame, "log_text").withColumnRenamed("text", "log_text")
    frame = salted_lookup(frame, bad.withColumn("_bad", F.lit(True)), "log_text").where("_bad is null").drop("_bad")
    store.save_dataset("documents", frame, audit.dataset_context(frame, source_columns=["log_text", "target", "split"]))
    run_id = train_run(store, "documents", Settings(representation="tfidf", classifier="lr"))
    rows, _ = store.analysis(analyze(store, run_id, "documents"))
    return rows.select("unit_id", "predicted", "score", "known_label", "explainability")


@register()
def pasted_message_scores(spark, d):
    """The benchmark texts typed in by a user, scored by the recommended configuration."""
    from logtide.plans.analysis import score_texts
    from logtide.plans.experiment import Settings, train_experiment

    labelled = V.document_logs(spark, d, "quality").where("_target is not null").withColumn("_session", F.lit(""))
    bundle = train_experiment(stored(labelled, "labelled"), Settings(representation="tfidf", classifier="lr"))
    rows = V.table(spark, d, "benchmark").select(F.col("item_id").alias("row_id"), F.col("text").alias("log_text"))
    return score_texts(bundle, rows)


@register()
def pasted_against_latest_run(spark, d):
    """The benchmark texts scored by the recommended model of the newer one of two stored runs."""
    from logtide.plans.analysis import score_with_latest, train_run
    from logtide.plans.experiment import Settings
    from logtide.runtime import new_path
    from logtide.sources.store import Store

    store = Store(spark, new_path(spark, "workspace"))
    labelled = V.document_logs(spark, d, "quality").where("_target is not null").withColumn("_session", F.lit(""))
    columns = ["row_id", "_text", "log_text", "_target", "_split", "_session", "_template", "_timestamp"]
    frame = labelled.select(*[c for c in columns if c in labelled.columns])
    store.save_dataset("documents", frame, spark.createDataFrame([(True, False, "documents")], "has_labels boolean, can_sessions boolean, name string"))
    for features in (500, None):
        train_run(store, "documents", Settings(representation="tfidf", classifier="lr", max_features=features))
    rows = V.table(spark, d, "benchmark").select(F.col("item_id").alias("row_id"), F.col("text").alias("log_text"))
    return score_with_latest(store, "documents", rows).drop("run_id")


@register(
    f"""WITH {V.RAW} SELECT row_id, CASE WHEN length(log_text) > 30 THEN concat(left(log_text, 30), '…') ELSE log_text END AS message,
    replace(anomaly_type, '_', ' ') AS anomaly FROM raw"""
)
def display_cells(spark, d):
    """Messages and names as a table shows them."""
    rows = V.raw_logs(spark, d)
    return rows.select("row_id", T.clip(F.col("log_text"), 30).alias("message"), T.prettified(F.col("anomaly_type")).alias("anomaly"))
