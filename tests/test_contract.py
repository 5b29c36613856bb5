"""Every rule of the log contract with a table that keeps it and one that breaks it; the one-pass profile by plain counting."""

import random

import pytest
from pyspark.sql import functions as F

from logtide.operators import audit, contract
from logtide.operators.prepare import RAW_COLUMNS

SPLITS = {"train": 28, "validation": 8, "test": 8}


def _table():
    rows = []
    for split, n in SPLITS.items():
        for i in range(n):
            bad = i % 2
            rows.append({
                "timestamp": f"2026-01-01T00:00:{i:02d}Z", "network_function": "AMF", "severity": ("INFO", "ERROR")[bad],
                "log_text": f"registration of subscriber {split}x{i} accepted after a handover between cells was completed in time",
                "label": ("normal", "abnormal")[bad], "anomaly_type": f"type{i // 2 % 2}" if bad else "none",
                "scenario_id": f"{split}-{i // 4}", "session_id": f"{split}-{i // 2}", "template_id": "T-new" if split == "test" and i == 7 else f"T{bad}",
                "split": split,
            })
    return rows


RULES = contract.log_rules(
    44, {"normal": 22, "abnormal": 22}, SPLITS, {f"{s}/{c}": n // 2 for s, n in SPLITS.items() for c in ("normal", "abnormal")},
    {"normal/INFO": 22, "abnormal/ERROR": 22}, {"type0": 11, "type1": 11},
)


def _broken(spark, rows):
    frame = spark.createDataFrame([tuple(r[c] for c in RAW_COLUMNS) for r in rows], ", ".join(f"{c} string" for c in RAW_COLUMNS))
    return {r["rule"] for r in contract.violations(frame, RULES, RAW_COLUMNS).collect()}


def _set(rows, column, value, where=lambda i: i == 0):
    for i, row in enumerate(rows):
        if where(i):
            row[column] = value(row) if callable(value) else value


CHANGES = {
    "rows": lambda rows: rows.append({**rows[0], "log_text": "one more " + rows[0]["log_text"]}),
    "rows with empty cells": lambda rows: _set(rows, "network_function", " "),
    "class": lambda rows: _set(rows, "label", "abnormal"),
    "split": lambda rows: _set(rows, "split", "test"),
    "split and class": lambda rows: (_set(rows, "label", "abnormal"), _set(rows, "label", "normal", lambda i: i == 29)),
    "class and severity": lambda rows: _set(rows, "severity", "WARNING"),
    "abnormal rows of a type": lambda rows: _set(rows, "anomaly_type", "type0", lambda i: i == 3),
    "normal rows with a type": lambda rows: _set(rows, "anomaly_type", "type0"),
    "scenarios in several splits": lambda rows: _set(rows, "scenario_id", "test-0"),
    "sessions in several splits": lambda rows: _set(rows, "session_id", "test-0"),
    "share of copied texts": lambda rows: _set(rows, "log_text", rows[5]["log_text"], lambda i: i in (7, 9)),
    "rows with label words": lambda rows: _set(rows, "log_text", lambda r: r["log_text"] + " Abnormal"),
    "templates in test only": lambda rows: _set(rows, "template_id", "T1", lambda i: True),
    "mean words": lambda rows: _set(rows, "log_text", lambda r: r["log_text"].split()[3], lambda i: True),
}


def test_a_table_that_keeps_every_rule(spark):
    assert _broken(spark, _table()) == set()
    assert {r.name for r in RULES} == {*CHANGES, "missing columns"}


@pytest.mark.parametrize("rule", sorted(CHANGES))
def test_a_table_that_breaks_one(spark, rule):
    rows = _table()
    CHANGES[rule](rows)
    assert rule in _broken(spark, rows)


def test_missing_columns_and_unlisted_cells(spark):
    frame = spark.createDataFrame([tuple(r[c] for c in RAW_COLUMNS) for r in _table()], ", ".join(f"{c} string" for c in RAW_COLUMNS))
    found = {(r["rule"], r["cell"]): r["value"] for r in contract.violations(frame.drop("session_id"), RULES, RAW_COLUMNS).collect()}
    assert found == {("missing columns", ""): 1.0}
    odd = frame.withColumn("label", F.when(F.col("log_text").contains("testx0"), "odd").otherwise(F.col("label")))
    found = {(r["rule"], r["cell"]): (r["value"], r["high"]) for r in contract.violations(odd, RULES, RAW_COLUMNS).collect()}
    assert found[("class", "odd")] == (1.0, 0.0) and found[("class", "normal")] == (21.0, 22.0)
    assert {r for r, _ in map(tuple, contract.violations(frame.limit(0), RULES, RAW_COLUMNS).select("rule", "cell").collect())} >= {"rows", "class"}


def test_context_counts_copies_and_blanks_of_the_raw_rows(spark):
    from logtide.operators.prepare import prepare_logs

    draw = random.Random(9)
    rows = [(draw.choice(["alpha beta", "beta gamma", "gamma"]), draw.choice(["s1", "s2", " "]), draw.choice(["AMF", " AMF", "", None])) for _ in range(60)]
    raw = spark.createDataFrame(rows, "message string, session_id string, network_function string")
    described = audit.dataset_context(prepare_logs(raw), raw, raw.columns).first()
    assert described["audit"]["duplicates"] == len(rows) - len(set(rows))
    assert described["audit"]["missing"] == {
        "message": 0, "session_id": sum(s == " " for _, s, _ in rows), "network_function": sum(n in ("", None) for *_, n in rows),
    }
    kept = sorted(set(rows), key=rows.index)
    assert described["row_count"] == len(kept) and described["unique_clean_texts"] == 3 and described["session_count"] == 2
    assert described["network_function_counts"] == {"AMF": sum((n or "").strip() == "AMF" for *_, n in kept)}
    empty = audit.dataset_context(prepare_logs(raw).limit(0), raw.limit(0), raw.columns).first()
    assert empty["row_count"] == 0 and empty["audit"]["duplicates"] == 0 and empty["split_counts"] == {}


def test_the_strict_cleaned_table_is_in_order_or_refused(spark):
    from logtide.operators.prepare import strict_cleaned_table

    rows = _table()
    random.Random(1).shuffle(rows)

    def frame(rows):
        columns = ", ".join(f"{c} string" for c in RAW_COLUMNS)
        return spark.createDataFrame([(i, *[r[c] for c in RAW_COLUMNS]) for i, r in enumerate(rows)], f"row_id bigint, {columns}")

    made = strict_cleaned_table(frame(rows)).collect()
    times = [r["timestamp"] for r in made]
    assert len(made) == len(rows) and times == sorted(times) and {r["target"] for r in made} == {0, 1}
    for column, value, message in (
        ("label", "odd", "1 unknown labels"), ("log_text", "!!!", "1 empty texts"), ("timestamp", "later", "1 bad times"),
        ("log_text", rows[1]["log_text"], "1 conflicting messages"),
    ):
        changed = [dict(r) for r in rows]
        if message.endswith("messages"):
            other = next(r for r in changed if r["label"] != changed[1]["label"])
            other[column] = value
        else:
            changed[0][column] = value
        with pytest.raises(ValueError, match=message):
            strict_cleaned_table(frame(changed))
