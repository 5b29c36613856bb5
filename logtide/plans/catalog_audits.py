"""Queries over the audit operators: counts, crosstabs, leakage, contracts and timelines."""

from pyspark.sql import functions as F

from logtide.functions import text as T
from logtide.operators import audit, contract, prepare
from logtide.plans import views as V
from logtide.plans.catalog import register


@register("SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1")
def value_counts(spark, d):
    return audit.value_counts(V.table(spark, d, "events"), "event_type")


@register(
    f"""WITH {V.DOCUMENTS} SELECT count(*) FILTER (_target = 0) AS normal, count(*) FILTER (_target = 1) AS abnormal,
    count(*) FILTER (_target IS NULL) AS unlabelled FROM docs"""
)
def label_counts(spark, d):
    return audit.label_counts(V.document_logs(spark, d))


@register(
    f"""WITH {V.DOCUMENTS} SELECT CASE _target WHEN 1 THEN 'Anomaly' WHEN 0 THEN 'Normal' ELSE 'Unlabelled' END AS label,
    count(*) AS count, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM docs GROUP BY 1"""
)
def class_balance(spark, d):
    return audit.class_balance(V.document_logs(spark, d)).withColumn("percent", F.round("percent", 6))


@register(
    f"""WITH {V.RAW} SELECT severity, count(*) FILTER (label = 'normal') AS normal, count(*) FILTER (label = 'abnormal') AS abnormal FROM raw GROUP BY 1"""
)
def severity_by_label(spark, d):
    return audit.crosstab(V.raw_logs(spark, d), "severity", "label", ["normal", "abnormal"])


@register(
    """SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'All' ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN grouping(o_orderpriority) = 1 THEN 'All' ELSE o_orderpriority END AS o_orderpriority, count(*) AS count
    FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"""
)
def crosstab_with_margins(spark, d):
    return audit.crosstab_margins(V.table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@register(f"WITH {V.RAW} SELECT split, label, count(*) AS count FROM raw GROUP BY ALL")
def split_label_sizes(spark, d):
    return audit.pair_sizes(V.raw_logs(spark, d), "split", "label")


@register(
    """SELECT 'text' AS "column", count(*) FILTER (text IS NULL OR trim(text) = '') AS missing FROM documents
    UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL OR trim(lang) = '') FROM documents
    UNION ALL SELECT 'quality', count(*) FILTER (l.quality IS NULL) FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    UNION ALL SELECT 'toxic', count(*) FILTER (l.toxic IS NULL) FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def missing_cells_per_column(spark, d):
    rows = V.table(spark, d, "documents").join(V.table(spark, d, "labels"), "doc_id", "left")
    return audit.missing_cells(rows, ["text", "lang", "quality", "toxic"])


@register(
    "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang, source)"
)
def exact_duplicate_rows(spark, d):
    return audit.duplicate_rows(V.table(spark, d, "documents"), ["text", "lang", "source"])


@register(
    f"""WITH {V.DOCUMENTS} SELECT count(DISTINCT _text) AS distinct_texts, count(*) - count(DISTINCT _text) AS repeated_rows, count(*) AS "rows",
    round((count(*) - count(DISTINCT _text)) / CAST(count(*) AS DOUBLE), 6) AS repeat_rate FROM docs"""
)
def repeated_text_rate(spark, d):
    return audit.text_repetition(V.document_logs(spark, d), "_text").withColumn("repeat_rate", F.round("repeat_rate", 6))


@register(
    f"""WITH {V.PREPARED} SELECT 'session_id' AS "column", count(DISTINCT session_id) AS distinct_values FROM prep
    UNION ALL SELECT 'template_id', count(DISTINCT template_id) FROM prep
    UNION ALL SELECT 'log_text', count(DISTINCT log_text) FROM prep UNION ALL SELECT '_text', count(DISTINCT _text) FROM prep"""
)
def distinct_value_counts(spark, d):
    columns = ["session_id", "template_id", "log_text", "_text"]
    return audit.distinct_counts(V.kept_logs(spark, d, *columns), columns)


@register(
    f"""WITH {V.RAW} SELECT 'label' AS "column", array_to_string(list_sort(list(DISTINCT label)), ',') AS values FROM raw
    UNION ALL SELECT 'severity', array_to_string(list_sort(list(DISTINCT severity)), ',') FROM raw
    UNION ALL SELECT 'split', array_to_string(list_sort(list(DISTINCT split)), ',') FROM raw"""
)
def distinct_value_lists(spark, d):
    lists = audit.value_lists(V.raw_logs(spark, d), ["label", "severity", "split"])
    return lists.select("column", F.array_join("values", ",").alias("values"))


@register(
    f"""WITH {V.PREPARED} SELECT _text AS key, count(*) AS copies FROM prep GROUP BY 1 HAVING count(DISTINCT _target) > 1
    UNION ALL SELECT source, count(*) FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1 HAVING count(DISTINCT toxic) > 1"""
)
def contradictory_keys(spark, d):
    logs = audit.key_profile(V.prepared_logs(spark, d), "_text", "_target").where(audit.contradictory())
    labelled = V.table(spark, d, "documents").join(V.table(spark, d, "labels"), "doc_id")
    sources = audit.key_profile(labelled, "source", "toxic").where(audit.contradictory())
    return logs.select("key", "copies").unionByName(sources.select("key", "copies"))


@register(
    f"""WITH {V.RAW}, moved AS (SELECT *, CASE WHEN row_id % 50 = 0 THEN 'test' ELSE split END AS s FROM raw)
    SELECT 'scenario_id' AS field, (SELECT count(*) FROM (SELECT scenario_id FROM moved GROUP BY 1 HAVING count(DISTINCT s) > 1)) AS leaking
    UNION ALL SELECT 'session_id', (SELECT count(*) FROM (SELECT session_id FROM moved GROUP BY 1 HAVING count(DISTINCT s) > 1))"""
)
def group_leakage_counts(spark, d):
    raw = V.raw_logs(spark, d)
    moved = raw.withColumn("_split", F.when(F.col("row_id") % 50 == 0, "test").otherwise(F.col("split")))
    return audit.group_leakage(moved)


@register(
    f"""WITH {V.PREPARED} SELECT count(*) AS session_label_conflicts FROM (SELECT _session FROM prep GROUP BY 1 HAVING count(DISTINCT _target) > 1)"""
)
def session_label_conflicts(spark, d):
    return audit.session_conflicts(V.prepared_logs(spark, d))


@register("SELECT count(*) FILTER (event_id % 5 = 4) AS invalid_timestamps FROM events")
def invalid_timestamp_count(spark, d):
    from logtide.functions import labels as L

    value = F.when(F.col("event_id") % 5 == 4, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    parsed = L.tolerant_timestamp(value)
    return V.table(spark, d, "events").agg(audit.total(parsed.isNull()).alias("invalid_timestamps"))


@register(
    f"""WITH {V.PURE} SELECT 'event labels' AS labels, (SELECT count(*) FROM (SELECT _session FROM prep GROUP BY 1 HAVING count(DISTINCT _target) > 1)) = 0 AS can_sessions
    UNION ALL SELECT 'session labels', (SELECT count(*) FROM (SELECT _session FROM pure GROUP BY 1 HAVING count(DISTINCT _target) > 1)) = 0"""
)
def session_eligibility_flags(spark, d):
    first = audit.session_eligibility(V.prepared_logs(spark, d)).withColumn("labels", F.lit("event labels"))
    second = audit.session_eligibility(V.session_logs(spark, d)).withColumn("labels", F.lit("session labels"))
    return first.unionByName(second)


@register(
    f"""WITH {V.PREPARED}, {V.DOCUMENTS} SELECT 'logs' AS source, bool_and(_target IS NOT NULL) AS has_labels FROM prep
    UNION ALL SELECT 'documents', bool_and(_target IS NOT NULL) FROM docs"""
)
def full_label_flags(spark, d):
    flag = F.bool_and(F.col("_target").isNotNull()).alias("has_labels")
    logs = V.prepared_logs(spark, d).agg(F.lit("logs").alias("source"), flag)
    return logs.unionByName(V.document_logs(spark, d).agg(F.lit("documents").alias("source"), flag))


_ALPHA = T.ALPHA_START_WORD


@register(
    f"""WITH {V.PREPARED} SELECT 'clean words' AS counted, round(avg(n), 2) AS mean_tokens, min(n) AS minimum, max(n) AS maximum, avg(n) BETWEEN 10 AND 30 AS mean_in_range
    FROM (SELECT len(string_split(_text, ' ')) AS n FROM prep)
    UNION ALL SELECT 'raw words', round(avg(n), 2), min(n), max(n), avg(n) BETWEEN 10 AND 30
    FROM (SELECT len(regexp_extract_all(log_text, '{_ALPHA}')) AS n FROM prep)"""
)
def token_length_statistics(spark, d):
    frame = V.prepared_logs(spark, d)
    clean = audit.token_lengths(frame, F.size(T.whitespace_tokens(F.col("_text"))))
    raw = audit.token_lengths(frame, T.alpha_token_count(F.col("log_text")))
    both = clean.withColumn("counted", F.lit("clean words")).unionByName(raw.withColumn("counted", F.lit("raw words")))
    return both.withColumn("minimum", F.col("minimum").cast("bigint")).withColumn("maximum", F.col("maximum").cast("bigint"))


@register(
    f"""WITH {V.RAW}, expected AS (SELECT split, label, (SELECT count(*) FROM raw) // 6 AS n FROM (SELECT DISTINCT split FROM raw), (SELECT DISTINCT label FROM raw)),
    actual AS (SELECT split, label, count(*) AS n FROM raw GROUP BY ALL)
    SELECT e.split, e.label, e.n AS expected, coalesce(a.n, 0) AS actual FROM expected e LEFT JOIN actual a ON e.split = a.split AND e.label = a.label WHERE e.n <> coalesce(a.n, 0)"""
)
def contract_violations(spark, d):
    """Even sixths per (split, label) as the expected contract."""
    raw = V.raw_logs(spark, d)
    cells = spark.createDataFrame(
        [(s, k) for s in ("train", "validation", "test") for k in ("normal", "abnormal")], "split string, label string"
    )
    expected = cells.withColumn("count", F.floor(raw.agg(F.count(F.lit(1)).alias("n")).scalar() / 6).cast("bigint"))
    return audit.contract_violations(raw, expected, ["split", "label"])


# Rules of the query below: what the derived logs would hold if all quotas were even, of a contract of 10,000 rows.
_RULES = contract.log_rules(
    10_000, {"normal": 5_000, "abnormal": 5_000}, {"train": 7_000, "validation": 1_500, "test": 1_500},
    {f"{s}/{c}": n // 2 for s, n in (("train", 7_000), ("validation", 1_500), ("test", 1_500)) for c in ("normal", "abnormal")},
    {"normal/INFO": 5_000, "abnormal/ERROR": 5_000}, {"error_large": 2_500, "error_small": 2_500},
)
_RULE_CELLS = {"class": "label", "split": "split", "split and class": "concat(split, '/', label)", "class and severity": "concat(label, '/', severity)"}
_RULE_VALUES = {
    "rows with empty cells": "SELECT count(*) FROM raw WHERE " + " OR ".join(f"coalesce(trim({c}), '') = ''" for c in prepare.RAW_COLUMNS),
    "normal rows with a type": "SELECT count(*) FROM raw WHERE label = 'normal' AND anomaly_type <> 'none'",
    "rows with label words": "SELECT count(*) FROM raw WHERE regexp_matches(log_text, '(?i)\\b(?:normal|abnormal)\\b')",
    "scenarios in several splits": "SELECT count(*) FROM (SELECT 1 FROM raw GROUP BY scenario_id HAVING count(DISTINCT split) > 1)",
    "sessions in several splits": "SELECT count(*) FROM (SELECT 1 FROM raw GROUP BY session_id HAVING count(DISTINCT split) > 1)",
    "templates in test only": "SELECT count(*) FROM (SELECT 1 FROM raw GROUP BY template_id HAVING min(split) = 'test' AND max(split) = 'test')",
    "rows": "SELECT count(*) FROM raw",
    "share of copied texts": "SELECT 1 - count(DISTINCT log_text) / count(*) FROM raw",
    "mean words": "SELECT avg(len(regexp_extract_all(log_text, '[A-Za-z][A-Za-z0-9_-]*'))) FROM raw",
    "missing columns": "SELECT 0",
}


def _rules_sql() -> str:
    bound = lambda x: "NULL" if x is None else str(float(x))
    rules = ", ".join(f"('{r.name}', '{r.cell}', {bound(r.low)}, {bound(r.high)})" for r in _RULES)
    parts = [f"SELECT '{name}', {cell}, count(*)::DOUBLE FROM raw GROUP BY 2" for name, cell in _RULE_CELLS.items()]
    parts += ["SELECT 'abnormal rows of a type', anomaly_type, count(*) FROM raw WHERE label = 'abnormal' GROUP BY 2"]
    parts += [f"SELECT '{name}', '', ({value})::DOUBLE" for name, value in _RULE_VALUES.items()]
    return f"""WITH {V.RAW}, rules(rule, cell, low, high) AS (VALUES {rules}), found(rule, cell, value) AS ({" UNION ALL ".join(parts)}),
    b AS (SELECT rule, cell, CAST(low AS DOUBLE) AS low, CAST(CASE WHEN rules.rule IS NULL THEN 0 ELSE high END AS DOUBLE) AS high, coalesce(value, 0) AS value
      FROM rules FULL JOIN found USING (rule, cell))
    SELECT rule, cell, low, high, round(value, 6) AS value, (low IS NULL OR value >= low) AND (high IS NULL OR value <= high) AS met FROM b
    WHERE NOT (rule IN ('rows with empty cells', 'normal rows with a type', 'rows with label words') AND value = 0 AND high IS NULL)"""


@register(_rules_sql())
def contract_report(spark, d):
    """Every rule of a contract with what the derived logs hold, and every cell that no rule lists."""
    values = contract.log_values(V.raw_logs(spark, d), prepare.RAW_COLUMNS)
    return contract.checked(values, _RULES).withColumn("value", F.round("value", 6))


@register(
    f"""WITH {V.RAW} SELECT CAST(0 AS BIGINT) AS rows_with_empty_cells, count(*) FILTER (regexp_matches(log_text, '(?i)\\b(?:normal|abnormal)\\b')) AS rows_with_label_words,
    count(*) FILTER (label = 'normal' AND anomaly_type <> 'none') AS normal_rows_with_anomaly_type FROM raw"""
)
def invariant_violations(spark, d):
    return audit.invariant_violations(V.raw_logs(spark, d), prepare.RAW_COLUMNS)


def _metrics_sql(cte: str, pairs: list[tuple[str, str]]) -> str:
    parts = [f"SELECT '{name}' AS metric, CAST(({sql}) AS DOUBLE) AS value" for name, sql in pairs]
    return f"WITH {cte} " + " UNION ALL ".join(parts)


_LEAK = "SELECT count(*) FROM (SELECT {0} FROM prep GROUP BY 1 HAVING count(DISTINCT split) > 1)"
_BOTH = "SELECT count(*) FROM (SELECT {0} FROM prep GROUP BY 1 HAVING count(DISTINCT _target) > 1)"
_OVERLAP = "SELECT count(*) FROM (SELECT {0} FROM prep WHERE split = 'train' INTERSECT SELECT {0} FROM prep WHERE split = 'test')"


@register(
    _metrics_sql(V.PREPARED, [
        ("rows_after_cleaning", "SELECT count(*) FROM prep"),
        ("mean_clean_tokens", "SELECT round(avg(len(string_split(_text, ' '))), 2) FROM prep"),
        ("minimum_clean_tokens", "SELECT min(len(string_split(_text, ' '))) FROM prep"),
        ("maximum_clean_tokens", "SELECT max(len(string_split(_text, ' '))) FROM prep"),
        ("severity_exceptions", "SELECT count(*) FROM prep WHERE (label = 'normal' AND severity = 'WARNING') OR (label = 'abnormal' AND severity = 'INFO')"),
        ("unique_raw_logs", "SELECT count(DISTINCT log_text) FROM prep"),
        ("unique_clean_texts", "SELECT count(DISTINCT _text) FROM prep"),
        ("scenario_split_leakage", _LEAK.format("scenario_id")),
        ("session_split_leakage", _LEAK.format("session_id")),
    ])
)
def quality_summary(spark, d):
    return audit.quality_summary(prepare.cleaned_table(V.raw_logs(spark, d)))


@register(
    _metrics_sql(V.PREPARED, [
        ("rows", "SELECT count(*) FROM prep"),
        ("unique_cleaned_messages", "SELECT count(DISTINCT _text) FROM prep"),
        ("repeated_cleaned_rows", "SELECT count(*) - count(DISTINCT _text) FROM prep"),
        ("train_test_message_overlap", _OVERLAP.format("_text")),
        ("messages_with_both_labels", _BOTH.format("_text")),
        ("unique_templates", "SELECT count(DISTINCT template_id) FROM prep"),
        ("train_test_template_overlap", _OVERLAP.format("template_id")),
        ("templates_with_both_labels", _BOTH.format("template_id")),
        ("sessions", "SELECT count(DISTINCT session_id) FROM prep"),
        ("sessions_in_multiple_splits", _LEAK.format("session_id")),
    ])
)
def audit_summary(spark, d):
    return audit.audit_summary(prepare.cleaned_table(V.raw_logs(spark, d)))


@register(
    _metrics_sql(V.RAW, [
        ("rows", "SELECT count(*) FROM raw"),
        ("empty_cells", "0"),
        ("invalid_timestamps", "0"),
        ("exact_duplicate_rows", "SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM raw GROUP BY log_text, \"timestamp\", session_id)"),
        ("duplicate_log_text", "SELECT count(*) - count(DISTINCT log_text) FROM raw"),
    ])
)
def pre_clean_audit(spark, d):
    return audit.pre_clean_audit(V.raw_logs(spark, d), prepare.RAW_COLUMNS)


@register(
    f"""WITH {V.PREPARED} SELECT count(*) AS row_count, count(*) FILTER (_target = 0) AS normal, count(*) FILTER (_target = 1) AS abnormal,
    count(DISTINCT _session) AS session_count, count(DISTINCT _template) AS template_count, count(DISTINCT _text) AS unique_clean_texts,
    true AS has_labels, (SELECT count(*) FROM (SELECT _session FROM prep GROUP BY 1 HAVING count(DISTINCT _target) > 1)) = 0 AS can_sessions,
    'log_text' AS text_column, count(*) FILTER (_split = 'train') AS train_rows, count(*) FILTER (network_function = 'CLICK') AS click_rows,
    count(*) FILTER (anomaly_type = 'error_large') AS large_errors, count(*) - count(DISTINCT _text) AS repeatedclean,
    (SELECT count(*) FROM (SELECT _text FROM prep WHERE split = 'train' INTERSECT SELECT _text FROM prep WHERE split = 'test')) AS text_overlap,
    (SELECT count(*) FROM (SELECT _template FROM prep WHERE split = 'train' INTERSECT SELECT _template FROM prep WHERE split = 'test')) AS template_overlap,
    CAST(0 AS BIGINT) AS leaking_sessions, CAST(0 AS BIGINT) AS bad_times, CAST(0 AS BIGINT) AS missing_text FROM prep"""
)
def dataset_context(spark, d):
    raw = V.raw_logs(spark, d)
    c = audit.dataset_context(V.prepared_logs(spark, d), raw, list(prepare.RAW_COLUMNS))
    return c.select(
        "row_count",
        F.col("label_counts")["normal"].alias("normal"),
        F.col("label_counts")["abnormal"].alias("abnormal"),
        "session_count", "template_count", "unique_clean_texts", "has_labels", "can_sessions", "text_column",
        F.col("split_counts")["train"].alias("train_rows"),
        F.col("network_function_counts")["CLICK"].alias("click_rows"),
        F.col("anomaly_type_counts")["error_large"].alias("large_errors"),
        F.col("audit.repeatedclean"),
        F.col("audit.train_test_text_overlap").alias("text_overlap"),
        F.col("audit.template_overlap").alias("template_overlap"),
        F.col("audit.group_leakage")["session_id"].alias("leaking_sessions"),
        F.col("audit.invalid_or_missing_timestamps").alias("bad_times"),
        F.col("audit.missing")["log_text"].alias("missing_text"),
    )


@register(f"WITH {V.PREPARED} SELECT _split AS value, count(*) AS count FROM prep GROUP BY 1")
def run_split_counts(spark, d):
    return audit.value_counts(V.prepared_logs(spark, d), "_split")


@register(f"WITH {V.SCORES} SELECT model_id, count(*) FILTER (predicted = 0) AS normal, count(*) FILTER (predicted = 1) AS anomaly FROM ev GROUP BY 1")
def outcome_summary(spark, d):
    from logtide.plans.catalog_scoring import evidence_rows

    rows = evidence_rows(spark, d)
    return rows.groupBy("model_id").agg(
        audit.total(F.col("predicted") == 0).alias("normal"), audit.total(F.col("predicted") == 1).alias("anomaly")
    )


@register(f"WITH {V.PREPARED} SELECT date_trunc('hour', _timestamp) AS time, CAST(sum(_target) AS BIGINT) AS count FROM prep GROUP BY 1")
def hourly_timeline(spark, d):
    rows = V.prepared_logs(spark, d).withColumn("predicted", F.col("_target"))
    return audit.hourly_timeline(rows).withColumn("time", F.col("time").cast("timestamp_ntz"))


@register(f"WITH {V.SESSIONS} SELECT date_trunc('hour', start_time) AS time, CAST(sum(_target) AS BIGINT) AS count FROM sess GROUP BY 1")
def session_timeline(spark, d):
    units = V.event_sessions(spark, d).heads.select(F.col("_target").alias("predicted"), "start_time")
    return audit.hourly_timeline(units, "start_time").withColumn("time", F.col("time").cast("timestamp_ntz"))


@register(
    f"""WITH {V.PREPARED} SELECT _session AS unit_id, min(_timestamp) AS start_time, arg_min(row_id, (_timestamp, row_id)) AS first_row,
    max(_target) AS label, min(_split) AS split FROM prep GROUP BY 1"""
)
def first_and_extreme_per_session(spark, d):
    first = F.struct("_timestamp", "row_id")
    return V.prepared_logs(spark, d).groupBy(F.col("_session").alias("unit_id")).agg(
        F.min("_timestamp").cast("timestamp_ntz").alias("start_time"),
        F.min_by("row_id", first).alias("first_row"),
        F.max("_target").alias("label"),
        F.min("_split").alias("split"),
    )


@register(
    """SELECT e.user_id, e.event_id, e.value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) e WHERE r = 1"""
)
def argmax_row(spark, d):
    best = F.max_by(F.struct("event_id", "value"), F.struct(F.col("value"), -F.col("event_id")))
    events = V.table(spark, d, "events").groupBy("user_id").agg(best.alias("b"))
    return events.select("user_id", "b.event_id", "b.value")


@register(
    f"""WITH {V.PREPARED} SELECT 'text' AS key, count(*) AS overlap FROM (SELECT _text FROM prep WHERE split = 'train' INTERSECT SELECT _text FROM prep WHERE split = 'test')
    UNION ALL SELECT 'template', count(*) FROM (SELECT _template FROM prep WHERE split = 'train' INTERSECT SELECT _template FROM prep WHERE split = 'test')"""
)
def train_test_overlap(spark, d):
    frame = V.prepared_logs(spark, d)
    return (
        audit.split_overlap(frame, "_text")
        .select(F.lit("text").alias("key"), "overlap")
        .unionByName(audit.split_overlap(frame, "_template").select(F.lit("template").alias("key"), "overlap"))
    )


@register(
    f"""WITH {V.DOCUMENTS} SELECT _text AS key FROM docs WHERE _split = 'test' EXCEPT SELECT _text FROM docs WHERE _split IN ('train', 'validation')"""
)
def texts_only_in_test(spark, d):
    return audit.only_in_test(V.document_logs(spark, d), "_text")
