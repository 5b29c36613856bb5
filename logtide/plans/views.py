"""Log tables derived from the analytic tables, and the same derivations as SQL text.

`events` becomes a telecom-style raw log, `documents` with `labels` a partly labelled upload,
`conversations` ordered sessions and integer arithmetic on events two score tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.functions import text as T
from logtide.operators import prepare
from logtide.operators.skew import sized_lookup
from logtide.operators.units import Units, log_units, session_units
from logtide.runtime import spread, stored

MODELS = ("logs__first__lr", "logs__second__lr")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _split_of(number: Column) -> Column:
    part = number % 7
    return F.when(part < 5, "train").when(part == 5, "validation").otherwise("test")


def raw_logs(spark: SparkSession, folder: str) -> DataFrame:
    """`row_id` and the ten text columns of the raw log table."""
    return _raw_logs(table(spark, folder, "events"))


def _raw_logs(e: DataFrame) -> DataFrame:
    session = F.col("user_id") * 100 + F.dayofmonth("ts")
    kind, value = F.col("event_type"), F.col("value")
    severity = (
        F.when((kind == "error") & (value < 5), "INFO")
        .when(kind == "error", "ERROR")
        .when((kind == "purchase") & (value > 60), "WARNING")
        .when(kind == "click", "DEBUG")
        .when(kind == "signup", "NOTICE")
        .otherwise("INFO")
    )
    message = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"),
        F.lit(" ["), F.upper(kind), F.lit("] "), severity,
        F.lit(" user supi-"), F.col("user_id"), F.lit(" ses-"), session,
        F.lit(" at 10."), F.col("user_id") % 256, F.lit("."), F.col("event_id") % 256, F.lit("."), F.col("event_id") % 100,
        F.lit(" value "), F.round(value * 100).cast("bigint"), F.lit("; "), F.col("props"),
    )
    return e.select(
        (F.col("event_id") + 1).alias("row_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.upper(kind).alias("network_function"),
        severity.alias("severity"),
        message.alias("log_text"),
        F.when(kind == "error", "abnormal").otherwise("normal").alias("label"),
        F.when((kind == "error") & (value < 20), "error_small").when(kind == "error", "error_large").otherwise("none").alias("anomaly_type"),
        F.concat(F.lit("SCN-"), F.col("user_id")).alias("scenario_id"),
        F.concat(F.lit("SES-"), session).alias("session_id"),
        F.concat(F.lit("TPL-"), kind).alias("template_id"),
        _split_of(F.col("user_id")).alias("split"),
    )


def prepared_logs(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.prepared_frame(_raw_logs(spread(table(spark, folder, "events"))), row_id="row_id")


def kept_logs(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Prepared logs for queries that read them several times: written once, with the wanted columns only."""
    return stored(prepared_logs(spark, folder).select(*columns), "prepared")


def session_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Prepared logs whose label is the session's: 1 when any event of the session is abnormal."""
    # Read for the labels and by every step on sessions.
    frame = stored(prepared_logs(spark, folder), "prepared")
    labels = frame.groupBy("_session").agg(F.max("_target").alias("_label"))
    return sized_lookup(frame, labels, "_session").withColumn("_target", F.col("_label")).drop("_label")


def event_sessions(spark: SparkSession, folder: str) -> Units:
    return session_units(session_logs(spark, folder))


def kept_sessions(spark: SparkSession, folder: str, *columns: str) -> Units:
    """Event sessions for queries that read them several times: written once, all columns if none are named."""
    built = event_sessions(spark, folder)
    return Units(stored(built.frame.select(*(columns or built.frame.columns)), "sessions"), built.group, built.segmented)


def raw_documents(spark: SparkSession, folder: str, label: str = "toxic") -> DataFrame:
    """Documents as an upload; `label` picks the column of `labels` that becomes the target."""
    d = table(spark, folder, "documents")
    toxic = table(spark, folder, "labels").select("doc_id", F.col(label).alias("target"))
    joined = sized_lookup(d, toxic, "doc_id")
    return joined.select(
        (F.col("doc_id") + 1).alias("row_id"), F.col("text").alias("log_text"), "target", F.col("source").alias("session_id"),
        F.concat(F.lit("TPL-"), F.col("lang")).alias("template_id"), _split_of(F.col("doc_id")).alias("split"),
    )


def document_logs(spark: SparkSession, folder: str, label: str = "toxic") -> DataFrame:
    """Documents as prepared log rows, copies kept: `row_id`, cleaned `_text`, `_target`, `_split`."""
    raw = raw_documents(spark, folder, label)
    return raw.select(
        "row_id",
        "log_text",
        T.clean_log_text(F.col("log_text")).alias("_text"),
        F.col("target").cast("int").alias("_target"),
        F.col("session_id").alias("_session"),
        F.col("template_id").alias("_template"),
        F.col("split").alias("_split"),
    )


def document_units(spark: SparkSession, folder: str) -> Units:
    return log_units(document_logs(spark, folder))


def chat_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as prepared rows; the turn number is the time order."""
    c = table(spark, folder, "conversations")
    start = F.timestamp_seconds(F.col("turn"))
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"),
        F.concat(F.lit("CONV-"), F.col("conv_id")).alias("_session"),
        start.alias("_timestamp"),
        T.clean_log_text(F.col("text")).alias("_text"),
        F.col("text").alias("log_text"),
        F.col("role").alias("_template"),
        (F.col("conv_id") % 4 == 0).cast("int").alias("_target"),
        _split_of(F.col("conv_id")).alias("_split"),
    )


def chat_sessions(spark: SparkSession, folder: str) -> Units:
    return session_units(chat_rows(spark, folder))


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """(model_id, unit_id, score, actual, _split): two pseudo-models over the events."""
    e = table(spark, folder, "events")
    target = (F.col("event_type") == "error").cast("bigint")
    first = (target * 300 + (F.col("event_id") * 7919 + F.col("user_id") * 31) % 701) / F.lit(1000.0)
    second = (target * 200 + (F.col("event_id") * 10473 + F.floor("value")) % 801) / F.lit(1000.0)
    entries = F.array(
        F.struct(F.lit(MODELS[0]).alias("model_id"), first.alias("score")),
        F.struct(F.lit(MODELS[1]).alias("model_id"), second.alias("score")),
    )
    return e.select(
        (F.col("event_id") + 1).alias("unit_id"),
        target.cast("int").alias("actual"),
        _split_of(F.col("user_id")).alias("_split"),
        F.explode(entries).alias("e"),
    ).select("e.model_id", "unit_id", "e.score", "actual", "_split")


# --- the same views as SQL ------------------------------------------------------------------


def clean_sql(expression: str) -> str:
    """The text cleaner as nested SQL calls."""
    text = f"lower(regexp_replace({expression}, '{T.LEADING_TIME}', ''))"
    for pattern, replacement in (*T.IDENTIFIERS, T.PRIVATE_ADDRESS, T.NUMBER):
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"
    return f"trim(replace(regexp_replace({text}, '[^a-z0-9_\\-]+', ' ', 'g'), '-', '_'))"


def split_sql(number: str) -> str:
    return f"CASE WHEN {number} % 7 < 5 THEN 'train' WHEN {number} % 7 = 5 THEN 'validation' ELSE 'test' END"


_SEVERITY = """CASE WHEN event_type = 'error' AND value < 5 THEN 'INFO' WHEN event_type = 'error' THEN 'ERROR'
 WHEN event_type = 'purchase' AND value > 60 THEN 'WARNING' WHEN event_type = 'click' THEN 'DEBUG'
 WHEN event_type = 'signup' THEN 'NOTICE' ELSE 'INFO' END"""

RAW = f"""raw AS (
 SELECT event_id + 1 AS row_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS "timestamp",
  upper(event_type) AS network_function, {_SEVERITY} AS severity,
  concat(strftime(ts, '%Y-%m-%d %H:%M:%S.%g'), ' [', upper(event_type), '] ', {_SEVERITY}, ' user supi-', user_id,
   ' ses-', user_id * 100 + day(ts), ' at 10.', user_id % 256, '.', event_id % 256, '.', event_id % 100,
   ' value ', CAST(round(value * 100) AS BIGINT), '; ', props) AS log_text,
  CASE WHEN event_type = 'error' THEN 'abnormal' ELSE 'normal' END AS label,
  CASE WHEN event_type = 'error' AND value < 20 THEN 'error_small' WHEN event_type = 'error' THEN 'error_large' ELSE 'none' END AS anomaly_type,
  concat('SCN-', user_id) AS scenario_id, concat('SES-', user_id * 100 + day(ts)) AS session_id,
  concat('TPL-', event_type) AS template_id, {split_sql('user_id')} AS split,
  date_trunc('milliseconds', ts) AS ts
 FROM events)"""

PREPARED = f"""{RAW}, prep AS (
 SELECT *, {clean_sql('log_text')} AS _text, CASE WHEN label = 'abnormal' THEN 1 ELSE 0 END AS _target,
  session_id AS _session, template_id AS _template, ts AS _timestamp, split AS _split
 FROM raw)"""

PURE = f"""{PREPARED}, pure AS (
 SELECT * REPLACE (max(_target) OVER (PARTITION BY _session) AS _target) FROM prep)"""

SESSIONS = f"""{PURE}, sess AS (
 SELECT _session AS unit_id, string_agg(_text, ' [EVENT] ' ORDER BY _timestamp, row_id) AS _text,
  list(_template ORDER BY _timestamp, row_id) AS log_keys, list(row_id ORDER BY _timestamp, row_id) AS row_ids,
  count(*) AS event_count, max(_target) AS _target, min(_split) AS _split,
  min(_timestamp) AS start_time, arg_min(anomaly_type, (_timestamp, row_id)) AS known_anomaly_type
 FROM pure GROUP BY _session)"""

DOCUMENTS = f"""docs AS (
 SELECT d.doc_id + 1 AS row_id, d.text AS log_text, {clean_sql('d.text')} AS _text, l.toxic AS _target,
  d.source AS _session, concat('TPL-', d.lang) AS _template, {split_sql('d.doc_id')} AS _split
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

CHATS = f"""chat AS (
 SELECT conv_id * 1000 + turn AS row_id, concat('CONV-', conv_id) AS _session, turn AS _time, {clean_sql('text')} AS _text,
  role AS _template, CASE WHEN conv_id % 4 = 0 THEN 1 ELSE 0 END AS _target, {split_sql('conv_id')} AS _split
 FROM conversations), chats AS (
 SELECT _session AS unit_id, string_agg(_text, ' [EVENT] ' ORDER BY _time, row_id) AS _text,
  list(_template ORDER BY _time, row_id) AS log_keys, count(*) AS event_count, max(_target) AS _target, min(_split) AS _split
 FROM chat GROUP BY _session)"""

SCORES = f"""scores AS (
 SELECT '{MODELS[0]}' AS model_id, event_id + 1 AS unit_id, CAST(event_type = 'error' AS INTEGER) AS actual, {split_sql('user_id')} AS _split,
  ((CASE WHEN event_type = 'error' THEN 300 ELSE 0 END) + (event_id * 7919 + user_id * 31) % 701) / CAST(1000 AS DOUBLE) AS score
 FROM events
 UNION ALL
 SELECT '{MODELS[1]}', event_id + 1, CAST(event_type = 'error' AS INTEGER), {split_sql('user_id')},
  ((CASE WHEN event_type = 'error' THEN 200 ELSE 0 END) + (event_id * 10473 + CAST(floor(value) AS BIGINT)) % 801) / CAST(1000 AS DOUBLE)
 FROM events), hist AS (
 SELECT model_id, score, sum(actual) AS pos, count(*) AS n FROM scores GROUP BY ALL), curve AS (
 SELECT model_id, score AS threshold, pos, n, sum(pos) OVER w AS tp, sum(n) OVER w AS flagged,
  sum(pos) OVER (PARTITION BY model_id) AS total_pos, sum(n) OVER (PARTITION BY model_id) AS total_n
 FROM hist WINDOW w AS (PARTITION BY model_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), pr AS (
 SELECT *, tp / CAST(flagged AS DOUBLE) AS "precision", tp / CAST(total_pos AS DOUBLE) AS recall,
  2 * (tp / CAST(flagged AS DOUBLE)) * (tp / CAST(total_pos AS DOUBLE))
   / ((tp / CAST(flagged AS DOUBLE)) + (tp / CAST(total_pos AS DOUBLE)) + CAST(1e-12 AS DOUBLE)) AS f1
 FROM curve), best AS (
 SELECT model_id, threshold, f1 AS validation_f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY f1 DESC, threshold) AS r FROM pr) WHERE r = 1), ev AS (
 SELECT s.*, b.threshold, CAST(s.score >= b.threshold AS INTEGER) AS predicted,
  CASE WHEN s.score >= b.threshold THEN s.score ELSE 1 - s.score END AS confidence,
  CASE WHEN s.actual = 1 THEN CASE WHEN s.score >= b.threshold THEN 'TP' ELSE 'FN' END
   ELSE CASE WHEN s.score >= b.threshold THEN 'FP' ELSE 'TN' END END AS outcome
 FROM scores s JOIN best b ON s.model_id = b.model_id)"""

# Lower-cased words of two or more word characters; bigrams of neighbours.
WORDS_SQL = "regexp_extract_all(lower(_text), '\\b\\w\\w+\\b')"


def terms_sql(source: str) -> str:
    """words(unit_id, toks) and terms(unit_id, term): unigrams and bigrams of `source`."""
    return f"""words AS (SELECT unit_id, _split, _target, {WORDS_SQL} AS toks FROM {source}), terms AS (
 SELECT unit_id, _split, _target, unnest(toks) AS term FROM words
 UNION ALL
 SELECT unit_id, _split, _target, unnest(list_transform(range(1, len(toks)), lambda i: concat(toks[i], ' ', toks[i + 1]))) FROM words)"""


def lexicon_sql(source: str, cap: int) -> str:
    """lex(term, tf, df, idf) fitted on the train rows of `source`."""
    return f"""{terms_sql(source)}, freq AS (
 SELECT term, count(*) AS tf, count(DISTINCT unit_id) AS df FROM terms WHERE _split = 'train' GROUP BY term), lex AS (
 SELECT term, tf, df, ln((1 + (SELECT count(*) FROM words WHERE _split = 'train')) / CAST(1 + df AS DOUBLE)) + 1 AS idf
 FROM freq WHERE df >= 2 ORDER BY tf DESC, term LIMIT {cap})"""
