"""Counts, crosstabs and leakage checks.

Per-key questions (copies, contradictions, leakage, overlaps) all come from `key_profile`: one
aggregation per key column with map-side combine, then a tiny aggregate over the profile. No
set is built, no pair is joined, and several distinct counts never share one expanded shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.functions import labels as L
from logtide.functions import text as T
from logtide.operators import contract
from logtide.operators.prepare import find_column, quoted


def total(condition: Column) -> Column:
    """Number of rows meeting the condition, as bigint, 0 on empty input."""
    return F.coalesce(F.sum(F.when(condition, F.lit(1).cast("bigint"))), F.lit(0).cast("bigint"))


def value_counts(frame: DataFrame, column: str) -> DataFrame:
    """(value, count) of the stripped values, blanks dropped, most frequent first."""
    value = T.strip(F.coalesce(quoted(column).cast("string"), F.lit("")))
    return (
        frame.select(value.alias("value"))
        .where(F.col("value") != "")
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "value")
    )


def label_counts(frame: DataFrame, target: str = "_target") -> DataFrame:
    return frame.agg(
        total(F.col(target) == 0).alias("normal"),
        total(F.col(target) == 1).alias("abnormal"),
        total(F.col(target).isNull()).alias("unlabelled"),
    )


def class_balance(frame: DataFrame, target: str = "_target") -> DataFrame:
    """(label, count, percent) per class tag."""
    counts = frame.groupBy(L.label_tag(F.col(target)).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    # At most three rows reach the window.
    return counts.withColumn("percent", 100.0 * F.col("count") / F.sum("count").over(Window.partitionBy()))


def crosstab(frame: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Row values against the given column values, missing cells 0."""
    return frame.groupBy(row).agg(*[total(F.col(column) == v).alias(str(v)) for v in values])


def crosstab_margins(frame: DataFrame, row: str, column: str) -> DataFrame:
    """Long crosstab with 'All' margins from one grouping-sets aggregation."""
    cubed = frame.cube(row, column).agg(
        F.count(F.lit(1)).alias("count"), F.grouping(row).alias("_r"), F.grouping(column).alias("_c")
    )
    return cubed.select(
        F.when(F.col("_r") == 1, "All").otherwise(F.col(row).cast("string")).alias(row),
        F.when(F.col("_c") == 1, "All").otherwise(F.col(column).cast("string")).alias(column),
        "count",
    )


def pair_sizes(frame: DataFrame, first: str, second: str) -> DataFrame:
    return frame.groupBy(first, second).agg(F.count(F.lit(1)).alias("count"))


def missing_cells(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, missing) for each column, from one scan."""
    counted = frame.agg(*[total(T.is_blank(quoted(c))).alias(f"m{i}") for i, c in enumerate(columns)])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(columns)])
    return counted.select(F.explode(entries).alias("e")).select("e.column", "e.missing")


def duplicate_rows(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each set of equal rows."""
    sizes = frame.groupBy(*[quoted(c) for c in columns]).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def key_profile(frame: DataFrame, key: str, target: str | None = None, split: str | None = None) -> DataFrame:
    """One row per key: copies, lowest and highest known label, number of splits, train/test presence."""
    measures = [F.count(F.lit(1)).alias("copies")]
    if target is not None:
        measures += [F.min(target).alias("low"), F.max(target).alias("high")]
    if split is not None:
        bits = reduce(
            lambda acc, item: acc.when(F.col(split) == item[1], F.lit(1 << item[0])),
            enumerate(L.PARTITIONS),
            F.when(F.lit(False), F.lit(0)),
        ).otherwise(0)
        measures.append(F.bit_or(bits).alias("splits"))
    return frame.groupBy(quoted(key).alias("key")).agg(*measures)


def in_split(name: str) -> Column:
    return F.col("splits").bitwiseAND(F.lit(1 << L.PARTITIONS.index(name))) != 0


def crosses_splits() -> Column:
    return F.bit_count(F.col("splits")) > 1


def contradictory() -> Column:
    return F.col("low") < F.col("high")


def text_repetition(frame: DataFrame, text: str) -> DataFrame:
    """Distinct texts, repeated rows and their rate."""
    profile = key_profile(frame, text)
    counted = profile.agg(
        F.count(F.lit(1)).alias("distinct_texts"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("repeated_rows"),
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
    )
    return counted.withColumn("repeat_rate", F.try_divide(F.col("repeated_rows").cast("double"), F.col("rows")))


def distinct_counts(frame: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """(column, distinct_values), blanks ignored. One narrow aggregation per column."""
    if approximate:
        found = frame.agg(
            *[F.approx_count_distinct(F.when(~T.is_blank(quoted(c)), quoted(c))).alias(f"d{i}") for i, c in enumerate(columns)]
        )
        entries = [F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("distinct_values")) for i, c in enumerate(columns)]
        return found.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    parts = [
        frame.select(quoted(c).cast("string").alias("v"))
        .where(~T.is_blank(F.col("v")))
        .groupBy("v")
        .agg(F.lit(1).alias("_x"))
        .agg(F.lit(c).alias("column"), F.count(F.lit(1)).alias("distinct_values"))
        for c in columns
    ]
    return reduce(DataFrame.unionByName, parts)


def value_rows(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value): distinct values, a row each, at any size."""
    parts = [frame.select(F.lit(column).alias("column"), quoted(column).cast("string").alias("value")).distinct() for column in columns]
    return reduce(DataFrame.unionByName, parts)


def value_lists(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, values): sorted distinct values of category columns, as one string array each.

    Values are made distinct by aggregation before they are collected. A list is one row however
    long it is; `value_rows` gives long ones as a table.
    """
    parts = [
        value_rows(frame, [column]).agg(F.lit(column).alias("column"), F.sort_array(F.collect_set("value")).alias("values"))
        for column in columns
    ]
    return reduce(DataFrame.unionByName, parts)


def leaking_keys(frame: DataFrame, key: str, split: str = "_split") -> DataFrame:
    """Ids seen in more than one split; blank ids and blank splits do not count."""
    known = frame.where(~T.is_blank(quoted(key)) & (F.coalesce(F.col(split), F.lit("")) != ""))
    cleaned = known.withColumn("_key", T.as_string(quoted(key)))
    return (
        cleaned.groupBy("_key")
        .agg(F.min(split).alias("_a"), F.max(split).alias("_b"))
        .where("_a <> _b")
        .select(F.col("_key").alias("key"))
    )


def group_leakage(frame: DataFrame, split: str = "_split") -> DataFrame:
    """(field, leaking) for scenario and session ids; 0 when the column is absent."""
    parts = []
    for field in ("scenario_id", "session_id"):
        name = find_column(frame.columns, (field,))
        source = frame.limit(0).select(F.lit("").alias("key")) if name is None else leaking_keys(frame, name, split)
        parts.append(source.agg(F.lit(field).alias("field"), F.count(F.lit(1)).alias("leaking")))
    return reduce(DataFrame.unionByName, parts)


def session_conflicts(frame: DataFrame, session: str = "_session", target: str = "_target") -> DataFrame:
    profile = key_profile(frame.where(F.col(session) != ""), session, target)
    return profile.agg(total(contradictory()).alias("session_label_conflicts"))


def split_overlap(frame: DataFrame, key: str, split: str = "_split") -> DataFrame:
    """Distinct keys found in both train and test."""
    return key_profile(frame, key, split=split).agg(total(in_split("train") & in_split("test")).alias("overlap"))


def only_in_test(frame: DataFrame, key: str, split: str = "_split") -> DataFrame:
    """Keys of the test split that neither other split has."""
    profile = key_profile(frame, key, split=split)
    return profile.where(F.col("splits") == (1 << L.PARTITIONS.index("test"))).select("key")


def session_eligibility(frame: DataFrame) -> DataFrame:
    """Whether session models may be used: real ids and templates everywhere, coherent labels."""
    has_columns = all(find_column(frame.columns, (name,)) for name in ("session_id", "template_id"))
    template = find_column(frame.columns, ("template_id",))
    generated = T.as_string(quoted(template)) == "" if template else F.lit(True)
    complete = frame.agg(
        F.coalesce(F.bool_and((F.col("_session") != "") & ~generated), F.lit(False)).alias("complete")
    )
    conflicts = session_conflicts(frame)
    return _side_by_side([complete, conflicts]).select(
        (F.lit(has_columns) & F.col("complete") & (F.col("session_label_conflicts") == 0)).alias("can_sessions")
    )


def _side_by_side(rows: Sequence[DataFrame]) -> DataFrame:
    """Columns of several one-row results in one row, joined on a constant key."""
    keyed = [row.withColumn("_one", F.lit(1)) for row in rows]
    return reduce(lambda a, b: a.join(b, "_one"), keyed).drop("_one")


def token_lengths(frame: DataFrame, count: Column, low: float = 10, high: float = 30) -> DataFrame:
    """Mean, smallest and largest token count, and whether the mean is in range."""
    found = frame.select(count.alias("n")).agg(
        F.avg("n").alias("mean"), F.min("n").alias("minimum"), F.max("n").alias("maximum")
    )
    return found.select(
        F.round("mean", 2).alias("mean_tokens"),
        "minimum",
        "maximum",
        F.col("mean").between(low, high).alias("mean_in_range"),
    )


def severity_exceptions() -> Column:
    """Normal rows at WARNING plus abnormal rows at INFO."""
    return total(
        ((F.col("label") == "normal") & (F.col("severity") == "WARNING"))
        | ((F.col("label") == "abnormal") & (F.col("severity") == "INFO"))
    )


def contract_violations(frame: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells whose row count differs from the expected table; empty when the contract holds."""
    actual = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("actual"))
    both = expected.select(*keys, F.col("count").alias("expected")).join(actual, list(keys), "full_outer")
    return both.select(
        *keys,
        F.coalesce("expected", F.lit(0)).cast("bigint").alias("expected"),
        F.coalesce("actual", F.lit(0)).cast("bigint").alias("actual"),
    ).where("expected <> actual")


def invariant_violations(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows breaking the row-level rules of the raw table, one count per rule."""
    blank = reduce(lambda a, b: a | b, [T.is_blank(quoted(c)) for c in columns])
    return frame.agg(
        total(blank).alias("rows_with_empty_cells"),
        total(T.has_label_word(F.col("log_text"))).alias("rows_with_label_words"),
        total((F.col("label") == "normal") & (F.col("anomaly_type") != "none")).alias("normal_rows_with_anomaly_type"),
    )


def quality_summary(frame: DataFrame) -> DataFrame:
    """Nine metrics of the cleaned table as (metric, value) rows."""
    rows = frame.select("label", "severity", F.size(T.whitespace_tokens(F.col("clean_text"))).alias("n")).agg(
        F.count(F.lit(1)).alias("rows_after_cleaning"),
        F.round(F.avg("n"), 2).alias("mean_clean_tokens"),
        F.min("n").alias("minimum_clean_tokens"),
        F.max("n").alias("maximum_clean_tokens"),
        severity_exceptions().alias("severity_exceptions"),
    )
    parts = [
        rows,
        key_profile(frame, "log_text").agg(F.count(F.lit(1)).alias("unique_raw_logs")),
        key_profile(frame, "clean_text").agg(F.count(F.lit(1)).alias("unique_clean_texts")),
        key_profile(frame, "scenario_id", split="split").agg(total(crosses_splits()).alias("scenario_split_leakage")),
        key_profile(frame, "session_id", split="split").agg(total(crosses_splits()).alias("session_split_leakage")),
    ]
    return as_metrics(_side_by_side(parts))


def audit_summary(frame: DataFrame) -> DataFrame:
    """The ten-check audit of the cleaned table as (metric, value) rows."""
    text = key_profile(frame, "clean_text", "target", "split").agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("unique_cleaned_messages"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("repeated_cleaned_rows"),
        total(in_split("train") & in_split("test")).alias("train_test_message_overlap"),
        total(contradictory()).alias("messages_with_both_labels"),
    )
    template = key_profile(frame, "template_id", "target", "split").agg(
        F.count(F.lit(1)).alias("unique_templates"),
        total(in_split("train") & in_split("test")).alias("train_test_template_overlap"),
        total(contradictory()).alias("templates_with_both_labels"),
    )
    session = key_profile(frame, "session_id", split="split").agg(
        F.count(F.lit(1)).alias("sessions"), total(crosses_splits()).alias("sessions_in_multiple_splits")
    )
    return as_metrics(_side_by_side([text, template, session]))


def pre_clean_audit(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts before cleaning: rows, empty cells, bad times, copied rows, copied texts."""
    cells = sum((F.when(F.coalesce(quoted(c), F.lit("")) == "", 1).otherwise(0) for c in columns), F.lit(0))
    base = raw.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(cells), F.lit(0)).alias("empty_cells"),
        total(L.tolerant_timestamp(F.col("timestamp")).isNull()).alias("invalid_timestamps"),
    )
    copies = duplicate_rows(raw, columns).withColumnRenamed("duplicates", "exact_duplicate_rows")
    texts = text_repetition(raw, "log_text").select(F.col("repeated_rows").alias("duplicate_log_text"))
    return as_metrics(_side_by_side([base, copies, texts]))


def as_metrics(row: DataFrame) -> DataFrame:
    """One wide row to (metric, value) rows."""
    entries = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.metric", "e.value")


def dataset_context(frame: DataFrame, raw: DataFrame | None = None, source_columns: Sequence[str] | None = None,
                    name: str = "uploaded") -> DataFrame:
    """One-row description of a prepared frame: counts, flags and the nested audit record."""
    source = list(source_columns or [c for c in frame.columns if not c.startswith("_") and c != "row_id"])
    template = find_column(source, ("template_id",))
    generated = (T.as_string(quoted(template)) == "") if template else F.lit(True)
    base = frame.agg(
        F.count(F.lit(1)).alias("row_count"),
        total(F.col("_target") == 0).alias("_normal"),
        total(F.col("_target") == 1).alias("_abnormal"),
        total(F.col("_target").isNull()).alias("unlabelled_rows"),
        F.coalesce(F.bool_and(F.col("_target").isNotNull()), F.lit(False)).alias("has_labels"),
        total(generated).alias("generated_templates"),
        total(F.col("_session") == "").alias("_blank_sessions"),
        total(F.col("_timestamp").isNull()).alias("_bad_times"),
    )
    known = {c: find_column(frame.columns, (c,)) for c in ("scenario_id", "session_id", "network_function", "anomaly_type")}

    def filled(column: str | None) -> Column:
        """The stripped value of a column; null where it is blank or there is none."""
        value = F.lit(None).cast("string") if column is None else T.strip(quoted(column).cast("string"))
        return F.when(value != "", value)

    counted = {"split_counts": "_split", "network_function_counts": known["network_function"], "anomaly_type_counts": known["anomaly_type"]}
    keys = {"text": F.col("_text"), "template": F.col("_template"), "session": F.when(F.col("_session") != "", F.col("_session"))}
    keys |= {c: filled(known[c]) for c in ("scenario_id", "session_id")}
    # Everything below is read from this one combined table.
    found = contract.profile(frame, {name: filled(c) for name, c in counted.items()}, keys, None, F.col("_split"), F.col("_target"))

    def number(question: str, condition: Column = F.lit(True)) -> Column:
        return F.count_if((F.col("question") == question) & F.coalesce(condition, F.lit(False)))

    def counts(question: str) -> Column:
        # Category columns: one entry per distinct value, already counted.
        entry = F.when(F.col("question") == question, F.struct(F.col("cell").alias("value"), F.col("n").alias("count")))
        return F.map_from_entries(F.collect_list(entry)).alias(question)

    shared = contract.in_split("train") & contract.in_split("test")
    leaking = [F.struct(F.lit(c).alias("field"), number(c, F.bit_count("splits") > 1).alias("leaking")) for c in ("scenario_id", "session_id")]
    answers = found.agg(
        number("text").alias("unique_clean_texts"),
        F.coalesce(F.sum(F.when(F.col("question") == "text", F.col("n") - 1)), F.lit(0)).alias("_repeated"),
        number("text", shared).alias("_text_overlap"),
        number("template").alias("template_count"),
        number("template", shared).alias("_template_overlap"),
        number("session").alias("session_count"),
        number("session", F.col("low") < F.col("high")).alias("_conflicts"),
        F.map_from_entries(F.array(*leaking)).alias("_leakage"),
        *[counts(name) for name in counted],
    )
    before = raw if raw is not None else frame
    row = _side_by_side([base, answers, _raw_cells(before, source)])
    has_columns = bool(template and find_column(source, ("session_id",)))
    text_name = find_column(source, ("clean_text", "log_text", "message", "log_message", "log", "text"))
    return row.select(
        F.lit(name).alias("name"),
        "row_count",
        F.create_map(F.lit("normal"), F.col("_normal"), F.lit("abnormal"), F.col("_abnormal")).alias("label_counts"),
        "split_counts", "network_function_counts", "anomaly_type_counts",
        "session_count", "template_count", "unique_clean_texts",
        F.array(*[F.lit(c) for c in source]).alias("columns"),
        F.lit("User-provided dataset").alias("source"),
        "has_labels",
        (F.lit(has_columns) & (F.col("_blank_sessions") == 0) & (F.col("generated_templates") == 0)
         & (F.col("_conflicts") == 0) & (F.col("row_count") > 0)).alias("can_sessions"),
        F.lit(text_name).alias("text_column"),
        "generated_templates", "unlabelled_rows",
        F.struct(
            F.col("_missing").alias("missing"), F.col("_duplicates").alias("duplicates"),
            F.col("_repeated").alias("repeatedclean"), F.col("_text_overlap").alias("train_test_text_overlap"),
            F.col("_template_overlap").alias("template_overlap"), F.col("_leakage").alias("group_leakage"),
            F.col("_conflicts").alias("session_label_conflicts"),
            F.col("_bad_times").alias("invalid_or_missing_timestamps"),
        ).alias("audit"),
    )


def _raw_cells(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Blank cells per column and rows beyond the first of each set of equal rows, from one pass over row hashes."""
    texts = [T.as_string(quoted(c)) for c in columns]
    nulls = F.concat(F.lit(""), *[F.when(quoted(c).isNull(), "1").otherwise("0") for c in columns])
    marks = [F.xxhash64(F.lit(side), nulls, *[quoted(c) for c in columns]).alias(f"_h{side}") for side in range(2)]
    blanks = F.array(*[(text == "").cast("int") for text in texts])
    rows = frame.select(*marks, blanks.alias("_blank")).groupBy("_h0", "_h1").agg(F.count(F.lit(1)).alias("_n"), F.first("_blank").alias("_blank"))
    entries = [
        F.struct(F.lit(c).alias("column"), F.coalesce(F.sum(F.col("_blank")[i] * F.col("_n")), F.lit(0)).alias("missing")) for i, c in enumerate(columns)
    ]
    return rows.agg(F.map_from_entries(F.array(*entries)).alias("_missing"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("_duplicates"))


def outcome_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(total(F.col("predicted") == 0).alias("normal"), total(F.col("predicted") == 1).alias("anomaly"))


def hourly_timeline(rows: DataFrame, time: str = "_timestamp") -> DataFrame:
    """(time, count): predicted anomalies per hour; rows without a time are left out."""
    hour = F.date_trunc("hour", F.col(time)).cast(rows.schema[time].dataType)
    return (
        rows.where(F.col(time).isNotNull())
        .groupBy(hour.alias("time"))
        .agg(F.sum(F.col("predicted").cast("bigint")).alias("count"))
    )


def unit_times(frame: DataFrame, sessions: bool) -> DataFrame:
    """(unit_id, unit_time): the row's own time, or the first time of the session."""
    if sessions:
        return frame.groupBy(F.col("_session").alias("unit_id")).agg(F.min("_timestamp").alias("unit_time"))
    return frame.select(F.col("row_id").cast("string").alias("unit_id"), F.col("_timestamp").alias("unit_time"))
