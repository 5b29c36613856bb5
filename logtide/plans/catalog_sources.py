"""Queries that write the derived tables to the shared folder and scan them back."""

from pyspark.sql import functions as F

from logtide.operators import audit, prepare
from logtide.plans import views as V
from logtide.plans.catalog import register
from logtide.plans.catalog_scoring import _COUNTS, evidence_rows, metrics_rows
from logtide.runtime import new_path
from logtide.sources import readers, writers
from logtide.sources.store import Store


@register(
    f"""WITH {V.RAW} SELECT network_function, severity, count(*) AS "rows", CAST(sum(length(log_text)) AS BIGINT) AS characters, min(session_id) AS first_session FROM raw GROUP BY ALL"""
)
def scan_csv_strings(spark, d):
    path = new_path(spark, "raw.csv")
    writers.write_raw(V.raw_logs(spark, d), path)
    raw = readers.read_csv_strings(spark, path)
    return raw.groupBy("network_function", "severity").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.length("log_text").cast("bigint")).alias("characters"), F.min("session_id").alias("first_session")
    )


@register(
    """WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS log_text FROM conversations)
    SELECT log_text, count(*) AS "rows" FROM lines WHERE trim(log_text) <> '' GROUP BY 1"""
)
def scan_text_lines(spark, d):
    path = new_path(spark, "messages.txt")
    V.table(spark, d, "conversations").select("text").write.text(path)
    return readers.read_lines(spark, path).groupBy("log_text").agg(F.count(F.lit(1)).alias("rows"))


def _json_documents(frame, value, path: str) -> str:
    """One JSON list per file, 5,000 entries each; `value` is the list built from column `entry`."""
    chunked = frame.groupBy(F.floor(F.col("row_id") / 5000).alias("chunk")).agg(F.collect_list("entry").alias("entries"))
    chunked.select("chunk", value.alias("value")).write.partitionBy("chunk").text(path)
    return f"{path}/chunk=*"


_JSON_SQL = f"""WITH {V.RAW} SELECT network_function, count(*) AS "rows", CAST(sum(length(log_text)) AS BIGINT) AS characters FROM raw GROUP BY 1"""


def _profile(frame):
    return frame.groupBy("network_function").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.length("log_text").cast("bigint")).alias("characters")
    )


@register(_JSON_SQL)
def scan_json_objects(spark, d):
    raw = V.raw_logs(spark, d).select("row_id", F.struct("network_function", "log_text").alias("entry"))
    path = _json_documents(raw, F.to_json("entries"), new_path(spark, "objects.json"))
    return _profile(readers.read_json_logs(spark, path))


@register(_JSON_SQL)
def scan_json_log_field(spark, d):
    raw = V.raw_logs(spark, d).select("row_id", F.struct("network_function", "log_text").alias("entry"))
    path = _json_documents(raw, F.to_json(F.struct(F.col("entries").alias("logs"))), new_path(spark, "wrapped.json"))
    return _profile(readers.read_json_logs(spark, path))


@register("""SELECT text AS log_text, count(*) AS "rows" FROM conversations GROUP BY 1""")
def scan_json_messages(spark, d):
    c = V.table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("row_id"), F.col("text").alias("entry"))
    path = _json_documents(c, F.to_json("entries"), new_path(spark, "messages.json"))
    return readers.read_json_logs(spark, path).groupBy("log_text").agg(F.count(F.lit(1)).alias("rows"))


@register(
    f"""WITH {V.PREPARED} SELECT split, count(*) AS "rows", CAST(sum(_target) AS BIGINT) AS abnormal, min(ts) AS first_time, max(ts) AS last_time,
    count(DISTINCT _text) AS texts FROM prep GROUP BY 1"""
)
def scan_cleaned_table(spark, d):
    path = new_path(spark, "cleaned.csv")
    writers.write_cleaned(prepare.cleaned_table(V.raw_logs(spark, d)), path, "csv")
    rows = readers.read_cleaned(spark, path)
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("target").cast("bigint")).alias("abnormal"),
        F.min("timestamp").cast("timestamp_ntz").alias("first_time"), F.max("timestamp").cast("timestamp_ntz").alias("last_time"),
        F.countDistinct("clean_text").alias("texts"),
    )


@register(f"""WITH {V.RAW} SELECT label, split, count(*) AS "rows", count(DISTINCT scenario_id) AS scenarios FROM raw GROUP BY ALL""")
def sink_raw_table(spark, d):
    path = new_path(spark, "raw.parquet")
    writers.write_raw(V.raw_logs(spark, d), path, "parquet")
    return spark.read.parquet(path).groupBy("label", "split").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("scenario_id").alias("scenarios"))


def _full_evidence(spark, d):
    logs = V.prepared_logs(spark, d).select(
        F.col("row_id").alias("unit_id"), "log_text", F.col("_session").alias("session_id"), F.col("anomaly_type").alias("known_anomaly_type")
    )
    rows = evidence_rows(spark, d).join(logs, "unit_id")
    text_id = F.col("unit_id").cast("string")
    return rows.withColumns({"row_id": text_id, "unit_id": text_id, "event_count": F.lit(1).cast("bigint")})


@register(
    f"""WITH {V.SCORES}, {V.PREPARED} SELECT CAST(unit_id AS VARCHAR) AS unit_id, p.log_text, p.session_id, score, outcome FROM ev JOIN prep p ON p.row_id = ev.unit_id
    WHERE model_id = '{V.MODELS[1]}'"""
)
def evidence_of_one_model(spark, d):
    path = new_path(spark, "evidence")
    writers.write_evidence(_full_evidence(spark, d), path)
    return readers.read_evidence(spark, path, V.MODELS[1]).select("unit_id", "log_text", "session_id", "score", "outcome")


@register(f"""WITH {_COUNTS} SELECT model_id, CAST(tp AS VARCHAR) AS tp, CAST(test_count AS VARCHAR) AS test_count, round(f1, 6) AS f1 FROM mx""")
def metrics_csv(spark, d):
    path = new_path(spark, "metrics")
    writers.write_metrics(metrics_rows(spark, d), path)
    rows = readers.read_csv_strings(spark, path)
    return rows.select("model_id", "tp", "test_count", F.round(F.col("f1").cast("double"), 6).alias("f1"))


@register(f"WITH {V.PREPARED} SELECT row_id, _split FROM prep")
def partition_assignment(spark, d):
    path = new_path(spark, "partitions")
    writers.write_partitions(V.prepared_logs(spark, d), path)
    return spark.read.parquet(path)


@register(
    f"""WITH {V.SCORES} SELECT count(*) AS "rows", count(*) FILTER (predicted = 1) AS anomaly, count(*) FILTER (predicted = 0) AS normal FROM ev WHERE model_id = '{V.MODELS[0]}'"""
)
def stored_analysis(spark, d):
    store = Store(spark, new_path(spark, "workspace"))
    rows = evidence_rows(spark, d).where(F.col("model_id") == V.MODELS[0])
    store.save_analysis("first", rows, {"summary": audit.outcome_summary(rows).first().asDict(), "dataset_id": "events"})
    saved = store.path("analyses", "first", "rows")
    summary = store.analyses().select("summary.*")
    return spark.read.parquet(saved).agg(F.count(F.lit(1)).alias("rows"), audit.total(F.col("predicted") == 1).alias("anomaly"), audit.total(F.col("predicted") == 0).alias("normal")).join(
        summary, ["anomaly", "normal"]
    )


@register(f"""WITH {V.PREPARED} SELECT row_id, _text, _target, _split FROM prep""")
def stored_dataset(spark, d):
    store = Store(spark, new_path(spark, "workspace"))
    frame = V.prepared_logs(spark, d)
    store.save_dataset("events", frame, audit.dataset_context(frame, source_columns=list(prepare.RAW_COLUMNS)))
    rows, _ = store.dataset("events")
    return rows.select("row_id", "_text", "_target", "_split")


@register(
    f"""WITH {_COUNTS} SELECT model_id, 'logs' AS "group", round(f1, 6) AS f1, round(fpr, 6) AS fpr, 'saved' AS source FROM mx
    UNION ALL SELECT replace(model_id, 'logs__', 'sessions__'), 'sessions', round(f1, 6), round(fpr, 6), 'saved' FROM mx"""
)
def saved_results_scan(spark, d):
    rows = metrics_rows(spark, d).select("model_id", F.lit("logs").alias("group"), F.round("f1", 6).alias("f1"), F.round("fpr", 6).alias("fpr"))
    twin = rows.select(F.regexp_replace("model_id", "^logs", "sessions").alias("model_id"), F.lit("sessions").alias("group"), "f1", "fpr")
    entry = F.struct("model_id", "group", "f1", "fpr")
    # A results document holds one entry per configuration.
    lists = rows.unionByName(twin).agg(
        F.collect_list(F.when(F.col("group") == "logs", entry)).alias("logs"), F.collect_list(F.when(F.col("group") == "sessions", entry)).alias("sessions")
    )
    document = lists.select(F.struct("logs", "sessions").alias("groups"), F.lit("saved").alias("source"), F.lit("round trip").alias("note"))
    path = new_path(spark, "results")
    document.coalesce(1).write.json(path)
    return readers.read_saved_results(spark, path)


@register(f"""WITH {V.RAW} SELECT count(*) AS "rows", true AS same_content FROM raw""")
def output_fingerprint(spark, d):
    """A table written in two layouts has one content fingerprint, and every file a SHA-256."""
    raw = V.raw_logs(spark, d)
    path = new_path(spark, "layout")
    raw.repartition(3).write.parquet(path)
    first, second = readers.content_fingerprint(raw), readers.content_fingerprint(spark.read.parquet(path))
    files = readers.file_fingerprint(spark, path).agg(F.bool_and(F.length("sha256") == 64).alias("hashed")).withColumn("_k", F.lit(1))
    both = first.join(second.withColumnRenamed("fingerprint", "other"), "rows").withColumn("_k", F.lit(1)).join(files, "_k")
    return both.select("rows", ((F.col("fingerprint") == F.col("other")) & F.col("hashed")).alias("same_content"))


@register(f"""WITH {_COUNTS} SELECT model_id, outcome, count(*) AS "rows" FROM ev WHERE model_id = '{V.MODELS[0]}' GROUP BY ALL""")
def export_predictions(spark, d):
    path = new_path(spark, "export")
    writers.export_csv(_full_evidence(spark, d).select(*writers.EVIDENCE_COLUMNS), path, "predictions", V.MODELS[0])
    return readers.read_csv_strings(spark, path).groupBy("model_id", "outcome").agg(F.count(F.lit(1)).alias("rows"))
