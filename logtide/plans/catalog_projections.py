"""Queries over the row-level expressions: cleaning, labels, times, splits and predicates."""

from pyspark.sql import functions as F

from logtide.functions import labels as L
from logtide.functions import text as T
from logtide.operators import audit, prepare, serve
from logtide.operators.skew import with_row_position
from logtide.plans import views as V
from logtide.plans.catalog import register


@register(f"WITH {V.PREPARED} SELECT row_id, _text FROM prep")
def clean_log_messages(spark, d):
    return V.raw_logs(spark, d).select("row_id", T.clean_log_text(F.col("log_text")).alias("_text"))


@register(f"SELECT doc_id, lang, {V.clean_sql('text')} AS _text FROM documents")
def clean_documents(spark, d):
    return V.table(spark, d, "documents").select("doc_id", "lang", T.clean_log_text(F.col("text")).alias("_text"))


@register(f"SELECT conv_id, turn, {V.clean_sql('text')} AS _text FROM conversations")
def clean_conversations(spark, d):
    return V.table(spark, d, "conversations").select("conv_id", "turn", T.clean_log_text(F.col("text")).alias("_text"))


def _rule_sql() -> str:
    parts = []
    rules = [*T.IDENTIFIERS, T.PRIVATE_ADDRESS, T.NUMBER]
    for pattern, name in rules:
        parts.append(
            f"SELECT '{name}' AS rule, CAST(coalesce(sum(len(regexp_extract_all(lower(log_text), '{pattern}'))), 0) AS BIGINT) AS hits FROM raw"
        )
    parts.append(f"SELECT 'leading_time', count(*) FROM raw WHERE regexp_matches(log_text, '{T.LEADING_TIME}')")
    return f"WITH {V.RAW} " + " UNION ALL ".join(parts)


@register(_rule_sql())
def masking_rule_hits(spark, d):
    raw = V.raw_logs(spark, d)
    rules = [*T.IDENTIFIERS, T.PRIVATE_ADDRESS, T.NUMBER]
    lowered = F.lower("log_text")
    found = raw.agg(
        *[F.sum(F.regexp_count(lowered, F.lit(p)).cast("bigint")).alias(name) for p, name in rules],
        audit.total(F.col("log_text").rlike(T.LEADING_TIME)).alias("leading_time"),
    )
    names = [name for _, name in rules] + ["leading_time"]
    return found.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("hits")) for n in names])).alias("e")
    ).select("e.*")


_STEPS = {
    "lowered": "lower(text)",
    "symbols_dropped": "regexp_replace(lower(text), '[^a-z0-9_\\-\\s]', ' ', 'g')",
    "joined": "replace(lower(text), '-', '_')",
    "collapsed": "trim(regexp_replace(text, '\\s+', ' ', 'g'))",
}


@register("SELECT item_id, " + ", ".join(f"{sql} AS {name}" for name, sql in _STEPS.items()) + " FROM benchmark")
def cleaning_steps(spark, d):
    t = F.col("text")
    return V.table(spark, d, "benchmark").select(
        "item_id",
        F.lower(t).alias("lowered"),
        F.regexp_replace(F.lower(t), r"[^a-z0-9_\-\s]", " ").alias("symbols_dropped"),
        F.translate(F.lower(t), "-", "_").alias("joined"),
        F.trim(F.regexp_replace(t, r"\s+", " ")).alias("collapsed"),
    )


@register(
    f"""WITH {V.PREPARED} SELECT row_id, "timestamp", network_function, severity, log_text, _text AS clean_text, label,
    CAST(_target AS TINYINT) AS target, anomaly_type, scenario_id, session_id, template_id, split FROM prep"""
)
def cleaned_table_projection(spark, d):
    return prepare.cleaned_table(V.raw_logs(spark, d))


@register(
    """SELECT d.doc_id, coalesce(trim(CAST(l.quality AS VARCHAR)), '') AS quality, trim(d.source) AS source, '' AS absent,
    l.toxic IS NULL AS toxic_blank FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def string_coercion(spark, d):
    rows = V.table(spark, d, "documents").join(V.table(spark, d, "labels"), "doc_id", "left")
    return rows.select(
        "doc_id",
        T.as_string(F.col("quality")).alias("quality"),
        T.as_string(F.col("source")).alias("source"),
        prepare.string_field(rows.columns, ("no_such_column",)).alias("absent"),
        T.is_blank(F.col("toxic")).alias("toxic_blank"),
    )


@register(
    """SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS row_id FROM events"""
)
def row_positions(spark, d):
    events = V.table(spark, d, "events").select("event_id", "ts")
    return with_row_position(events, [F.col("ts"), F.col("event_id")]).select("event_id", "row_id")


@register("SELECT text, lang, source, min(doc_id) AS row_id FROM documents GROUP BY text, lang, source")
def first_of_duplicate_rows(spark, d):
    documents = V.table(spark, d, "documents").withColumnRenamed("doc_id", "row_id")
    return prepare.first_of_duplicates(documents, ["text", "lang", "source"])


@register(
    f"""WITH {V.DOCUMENTS} SELECT CAST(count(*) FILTER (trim(log_text) = '') AS BIGINT) AS blank_text,
    CAST(count(*) FILTER (trim(_text) = '') AS BIGINT) AS empty_after_cleaning, count(*) AS "rows",
    0::BIGINT AS bad_split, 0::BIGINT AS label_disagreement, 0::BIGINT AS bad_label_0 FROM docs"""
)
def input_rule_violations(spark, d):
    frame = V.document_logs(spark, d).withColumn("target", F.col("_target"))
    found = prepare.input_problems(frame, ["log_text", "target"])
    return found.select(*[F.col(c).cast("bigint").alias(c) for c in found.columns if c != "bad_label_row_0"])


_FORMS = ("'Normal'", "' ABNORMAL '", "'1.0'", "'0'", "''", "NULL", "'2'", "'benign'", "'anomalous'", "'unclear'", "'1e0'", "'-1'")
_FORM_SQL = "CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(_FORMS)) + " END"


@register(
    f"""SELECT doc_id, CASE WHEN lower(trim(v)) IN ('normal', 'benign', '0') THEN 0
    WHEN lower(trim(v)) IN ('abnormal', 'anomalous', 'anomaly', '1.0', '1e0') THEN 1 END AS label,
    coalesce(lower(trim(v)) IN ('2', 'unclear', '-1'), false) AS invalid FROM (SELECT doc_id, {_FORM_SQL} AS v FROM documents)"""
)
def binary_label_parse(spark, d):
    rows = V.table(spark, d, "documents").select("doc_id", F.expr(_FORM_SQL).alias("v"))
    return rows.select("doc_id", L.binary_label(F.col("v")).alias("label"), L.binary_label_invalid(F.col("v")).alias("invalid"))


@register(f"WITH {V.PREPARED} SELECT row_id, _target AS target FROM prep")
def strict_label_map(spark, d):
    return V.raw_logs(spark, d).select("row_id", L.strict_label(F.col("label")).alias("target"))


@register(
    """SELECT doc_id, coalesce(quality, toxic) AS label, quality IS NOT NULL AND toxic IS NOT NULL AND quality <> toxic AS disagree
    FROM (SELECT d.doc_id, CASE WHEN d.doc_id % 3 > 0 THEN l.quality END AS quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
)
def label_coalesce(spark, d):
    rows = V.table(spark, d, "documents").join(V.table(spark, d, "labels"), "doc_id", "left")
    first = L.binary_label(F.when(F.col("doc_id") % 3 > 0, F.col("quality")))
    second = L.binary_label(F.col("toxic"))
    disagree = first.isNotNull() & second.isNotNull() & (first != second)
    return rows.select("doc_id", F.coalesce(first, second).alias("label"), F.coalesce(disagree, F.lit(False)).alias("disagree"))


@register(
    f"""WITH {V.PREPARED} SELECT row_id, CASE WHEN row_id % 3 = 0 THEN concat('GENERATED-', substr(sha256(_text), 1, 16))
    ELSE template_id END AS _template FROM prep"""
)
def generated_templates(spark, d):
    raw = V.raw_logs(spark, d)
    raw = raw.withColumn("template_id", F.when(F.col("row_id") % 3 == 0, " ").otherwise(F.col("template_id")))
    columns = [c for c in raw.columns if c != "row_id"]
    return prepare.with_model_columns(raw, columns).select("row_id", "_template")


_TIME_SQL = """CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
 WHEN 2 THEN strftime(ts, '%m/%d/%Y %H:%M:%S') WHEN 3 THEN strftime(ts, '%d %b %Y %H:%M:%S') ELSE 'not a time' END"""


# Notations that events are written in, and what of the time each one keeps.
_NOTATIONS = (
    ("M/d/yyyy", "day"), ("MM/dd/yyyy HH:mm", "minute"), ("MMM d, yyyy", "day"), ("dd-MMM-yyyy", "day"), ("yyyy/MM/dd HH:mm:ss.SSS", "milliseconds"),
    ("MMMM d, yyyy h:mm:ss a", "second"), ("EEE, dd MMM yyyy HH:mm:ss", "second"), ("yyyyMMdd", "day"), ("d MMM yyyy HH:mm:ss +0000", "second"),
    ("yyyy.MM.dd H:mm", "minute"), ("MMM d yyyy HH:mm:ss.SSS", "milliseconds"), ("M-d-yyyy", "day"), ("yyyy MMM d", "day"),
)


@register(
    "SELECT event_id, CASE event_id % 13 "
    + " ".join(f"WHEN {i} THEN date_trunc('{unit}', ts)" for i, (_, unit) in enumerate(_NOTATIONS))
    + " END AS parsed FROM events"
)
def time_notations(spark, d):
    """The time of each event, written in one of thirteen notations and read again."""
    written = F.lit(None).cast("string")
    for i, (form, _) in enumerate(_NOTATIONS):
        written = F.when(F.col("event_id") % len(_NOTATIONS) == i, F.date_format("ts", form.replace(" +0000", "' +0000'"))).otherwise(written)
    return V.table(spark, d, "events").select("event_id", L.tolerant_timestamp(written).cast("timestamp_ntz").alias("parsed"))


@register(
    """SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 5 = 0 THEN date_trunc('milliseconds', ts)
    ELSE date_trunc('second', ts) END AS parsed FROM events"""
)
def tolerant_time_parse(spark, d):
    forms = ["yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "dd MMM yyyy HH:mm:ss"]
    value = F.lit("not a time")
    for i, form in enumerate(forms):
        value = F.when(F.col("event_id") % 5 == i, F.date_format("ts", form)).otherwise(value)
    parsed = L.tolerant_timestamp(value).cast("timestamp_ntz")
    return V.table(spark, d, "events").select("event_id", parsed.alias("parsed"))


@register(f"WITH {V.RAW} SELECT row_id, ts AS parsed FROM raw")
def strict_time_parse(spark, d):
    return V.raw_logs(spark, d).select("row_id", L.strict_timestamp(F.col("timestamp")).cast("timestamp_ntz").alias("parsed"))


@register(
    """SELECT user_id, CASE user_id % 6 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' WHEN 2 THEN 'validation' WHEN 3 THEN 'validation'
    WHEN 4 THEN 'test' ELSE 'trian' END AS _split, user_id % 6 = 5 AS unknown, count(*) AS "rows" FROM events GROUP BY ALL"""
)
def split_name_normalise(spark, d):
    raw = F.element_at(F.array(*map(F.lit, ("Train", " VAL", "valid", "Dev ", "TEST", "trian"))), (F.col("user_id") % 6 + 1).cast("int"))
    name = L.split_name(raw)
    rows = V.table(spark, d, "events").select("user_id", name.alias("_split"), (~name.isin("", *L.PARTITIONS)).alias("unknown"))
    return rows.groupBy("user_id", "_split", "unknown").agg(F.count(F.lit(1)).alias("rows"))


@register(f"WITH {V.PREPARED} SELECT row_id, _text, _target FROM prep WHERE _split = 'validation'")
def filter_split(spark, d):
    return V.prepared_logs(spark, d).where(F.col("_split") == "validation").select("row_id", "_text", "_target")


@register("SELECT doc_id, lang FROM documents WHERE contains(lower(text), lower('In Die.'))")
def search_text_literal(spark, d):
    return V.table(spark, d, "documents").where(T.contains_literal(F.col("text"), "In Die.")).select("doc_id", "lang")


@register(
    f"""WITH {V.PREPARED} SELECT row_id, log_text, _text AS clean_text, array_to_string(string_split(_text, ' '), '|') AS tokens,
    (SELECT count(*) FROM prep p WHERE p._session = (SELECT _session FROM prep q WHERE q.row_id = 42)) AS session_count FROM prep WHERE row_id = 42"""
)
def record_lookup(spark, d):
    found = serve.record(V.prepared_logs(spark, d), 42)
    return found.select("row_id", "log_text", "clean_text", F.array_join("tokens", "|").alias("tokens"), "session_count")


@register("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\\b(?:normal|abnormal)\\b')")
def label_word_rows(spark, d):
    return V.table(spark, d, "documents").where(T.has_label_word(F.col("text"))).select("doc_id")


@register(
    f"""WITH {V.RAW} SELECT CAST(count(*) FILTER ((label = 'normal' AND severity = 'WARNING') OR (label = 'abnormal' AND severity = 'INFO')) AS BIGINT)
    AS severity_exceptions FROM raw"""
)
def severity_exception_count(spark, d):
    return V.raw_logs(spark, d).agg(audit.severity_exceptions().alias("severity_exceptions"))


@register(
    """SELECT event_id, CASE WHEN event_id % 10 < 3 THEN NULL ELSE value END AS value,
    strftime(date_trunc('milliseconds', ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM events"""
)
def json_safe_values(spark, d):
    part = F.col("event_id") % 10
    odd = (
        F.when(part == 0, float("nan")).when(part == 1, float("inf")).when(part == 2, float("-inf")).otherwise(F.col("value"))
    )
    record = F.to_json(F.struct(L.finite_or_null(odd).alias("value"), L.iso_time(F.col("ts")).alias("iso")))
    parsed = F.from_json(record, "value double, iso string")
    return V.table(spark, d, "events").select("event_id", parsed["value"].alias("value"), parsed["iso"].alias("iso"))


@register(
    """SELECT CASE WHEN toxic = 1 THEN 'Anomaly' WHEN toxic = 0 THEN 'Normal' ELSE 'Unlabelled' END AS tag, count(*) AS "rows"
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1"""
)
def label_tag_counts(spark, d):
    rows = V.table(spark, d, "documents").join(V.table(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy(L.label_tag(F.col("toxic")).alias("tag")).agg(F.count(F.lit(1)).alias("rows"))


@register(
    f"""WITH {V.PREPARED} SELECT row_id, log_text, _text, _target, _session, _template, _timestamp, _split FROM prep"""
)
def prepare_upload(spark, d):
    frame = prepare.prepare_logs(V.raw_logs(spark, d), row_id="row_id")
    return frame.select("row_id", "log_text", "_text", "_target", "_session", "_template", F.col("_timestamp").cast("timestamp_ntz").alias("_timestamp"), "_split")


@register(
    f"""WITH {V.RAW}, r AS (SELECT CASE WHEN row_id % 90 = 0 THEN 'later' ELSE timestamp END AS t, CASE WHEN row_id % 70 = 0 THEN '!!!' ELSE log_text END AS m,
    CASE WHEN row_id % 50 = 0 THEN 'odd' ELSE label END AS label FROM raw)
    SELECT count(*) FILTER (label = 'odd') AS unknown_labels, count(*) FILTER (m = '!!!') AS empty_texts, count(*) FILTER (t = 'later') AS bad_times,
    (SELECT count(*) FROM (SELECT m FROM r GROUP BY m HAVING count(DISTINCT label) > 1)) AS conflicting_messages FROM r"""
)
def cleaned_table_problems(spark, d):
    """The guards of the cleaned table on logs in which some labels, texts and times were spoilt."""
    raw = V.raw_logs(spark, d)
    nth = lambda n: F.col("row_id") % n == 0
    spoilt = raw.withColumns({
        "timestamp": F.when(nth(90), "later").otherwise(F.col("timestamp")),
        "log_text": F.when(nth(70), "!!!").otherwise(F.col("log_text")),
        "label": F.when(nth(50), "odd").otherwise(F.col("label")),
    })
    return prepare.cleaned_problems(prepare.cleaned_table(spoilt))
