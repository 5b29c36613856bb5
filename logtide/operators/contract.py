"""One keyed pass over a table for many questions, and data contracts checked against its answers.

Each row is unpivoted to an entry per question: the cell it counts in, or the hash of the key it shows. Entries are
combined once, within tasks and then by question and cell or key. All counts, copies, leaks and overlaps follow from that
one table, and a contract is a list of rules that its summary is compared with.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.functions import labels as L
from logtide.functions import text as T
from logtide.runtime import stored

_PRESENT = {name: 1 << place for place, name in enumerate(L.PARTITIONS)}


def profile(frame: DataFrame, cells: Mapping[str, Column], keys: Mapping[str, Column], amounts: Mapping[str, Column] | None = None,
            split: Column | None = None, target: Column | None = None) -> DataFrame:
    """(question, cell, key, n, splits, low, high, amount): entries of all questions, combined in one shuffle.

    `cells` are values with few forms, kept as text; `keys` are told apart by 128 bits of hash; `amounts` are summed. A
    null is no entry. `splits` has a bit for each partition that an entry occurs in, `low` and `high` are its labels.
    """
    none = F.lit(None)

    def entry(question: str, cell: Column = none, key: Column = none, amount: Column = none) -> Column:
        return F.struct(
            F.lit(question).alias("question"), cell.cast("string").alias("cell"), key.cast("struct<a:bigint,b:bigint>").alias("key"),
            amount.cast("double").alias("amount"),
        )

    def hashed(value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit("second"), value).alias("b")))

    entries = [entry(name, cell=value) for name, value in cells.items()]
    entries += [entry(name, key=hashed(value.cast("string"))) for name, value in keys.items()]
    entries += [entry(name, amount=value) for name, value in (amounts or {}).items()]
    bits = F.lit(0)
    if split is not None:
        for name, bit in _PRESENT.items():
            bits = F.when(split == name, F.lit(bit)).otherwise(bits)
    label = none.cast("int") if target is None else target
    rows = frame.select(bits.alias("_bits"), label.alias("_label"), F.explode(F.array(*entries)).alias("e"))
    known = rows.where("e.cell IS NOT NULL OR e.key IS NOT NULL OR e.amount IS NOT NULL")
    combined = known.groupBy(F.col("e.question").alias("question"), F.col("e.cell").alias("cell"), F.col("e.key").alias("key")).agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_or("_bits").alias("splits"),
        F.min("_label").alias("low"),
        F.max("_label").alias("high"),
        F.sum("e.amount").alias("amount"),
    )
    return stored(combined, "profile")


def in_split(name: str) -> Column:
    return F.col("splits").bitwiseAND(F.lit(_PRESENT[name])) != 0


def measures(found: DataFrame) -> DataFrame:
    """(question, keys, rows, copies, crossing, shared, only_test, conflicts, amount): a row for each question."""
    asked = F.col("cell").isNull()

    def number(condition: Column) -> Column:
        return F.count_if(asked & F.coalesce(condition, F.lit(False)))

    return found.groupBy("question").agg(
        F.count(F.lit(1)).alias("keys"),
        F.sum("n").alias("rows"),
        (F.sum("n") - F.count(F.lit(1))).alias("copies"),
        number(F.bit_count("splits") > 1).alias("crossing"),
        number(in_split("train") & in_split("test")).alias("shared"),
        number(F.col("splits") == _PRESENT["test"]).alias("only_test"),
        number(F.col("low") < F.col("high")).alias("conflicts"),
        F.sum("amount").alias("amount"),
    )


@dataclass(frozen=True)
class Rule:
    """The value of a rule, or of one of its cells, lies from `low` to `high`; None is no bound."""

    name: str
    low: float | None = None
    high: float | None = None
    cell: str = ""


def quotas(name: str, counts: Mapping[str, int]) -> list[Rule]:
    """A rule per cell: exactly this many rows. Cells that are not listed may not occur."""
    return [Rule(name, n, n, cell) for cell, n in counts.items()]


# Cells that rules count in, made of the columns of the raw table.
CELLS = {
    "class": ("label",),
    "split": ("split",),
    "split and class": ("split", "label"),
    "class and severity": ("label", "severity"),
}
MOST_COPIED, TOKENS = 0.03, (10.0, 30.0)


def log_rules(rows: int, classes: Mapping[str, int], splits: Mapping[str, int], split_classes: Mapping[str, int],
              severities: Mapping[str, int], anomaly_types: Mapping[str, int]) -> list[Rule]:
    """The contract of a generated log table; cells of two columns are written `a/b`."""
    return [
        Rule("rows", rows, rows),
        Rule("missing columns", 0, 0),
        Rule("rows with empty cells", 0, 0),
        *quotas("class", classes),
        *quotas("split", splits),
        *quotas("split and class", split_classes),
        *quotas("class and severity", severities),
        *quotas("abnormal rows of a type", anomaly_types),
        Rule("normal rows with a type", 0, 0),
        Rule("scenarios in several splits", 0, 0),
        Rule("sessions in several splits", 0, 0),
        Rule("share of copied texts", 0, MOST_COPIED),
        Rule("rows with label words", 0, 0),
        Rule("templates in test only", 1, None),
        Rule("mean words", *TOKENS),
    ]


def log_values(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(rule, cell, value): what a raw log table has for every rule, from one pass over it."""
    absent = [c for c in columns if c not in frame.columns]
    whole = frame.withColumns({c: F.lit(None).cast("string") for c in absent})
    empty = F.lit(False)
    for c in columns:
        if c not in absent:
            empty = empty | T.is_blank(F.col(c))
    mark = lambda condition: F.when(condition, "")
    cells = {name: F.concat_ws("/", *parts) for name, parts in CELLS.items()}
    cells |= {
        "abnormal rows of a type": F.when(F.col("label") == "abnormal", F.coalesce("anomaly_type", F.lit(""))),
        "rows with empty cells": mark(empty),
        "normal rows with a type": mark((F.col("label") == "normal") & (F.col("anomaly_type") != "none")),
        "rows with label words": mark(T.has_label_word(F.col("log_text"))),
    }
    keys = {"scenario": F.col("scenario_id"), "session": F.col("session_id"), "text": F.coalesce("log_text", F.lit("")), "template": F.col("template_id")}
    found = profile(whole, cells, keys, {"words": T.alpha_token_count(F.coalesce("log_text", F.lit("")))}, F.col("split"))
    counted = found.where("cell IS NOT NULL").select(F.col("question").alias("rule"), "cell", F.col("n").cast("double").alias("value"))
    summary = measures(found.where("cell IS NULL"))
    answers = (
        ("scenarios in several splits", "scenario", F.col("crossing")),
        ("sessions in several splits", "session", F.col("crossing")),
        ("templates in test only", "template", F.col("only_test")),
        ("rows", "text", F.col("rows")),
        ("share of copied texts", "text", F.col("copies") / F.col("rows")),
        ("mean words", "words", F.col("amount") / F.col("rows")),
    )
    entries = F.array(
        *[F.struct(F.lit(rule).alias("rule"), F.lit(question).alias("of"), value.cast("double").alias("value")) for rule, question, value in answers]
    )
    told = summary.select("question", F.explode(entries).alias("e")).where("question = e.of").select("e.rule", F.lit("").alias("cell"), "e.value")
    lacking = frame.sparkSession.createDataFrame([("missing columns", "", float(len(absent)))], "rule string, cell string, value double")
    return counted.unionByName(told).unionByName(lacking)


def checked(values: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule, cell, low, high, value, met) for every rule and every cell that occurs; an absent value is 0."""
    rows = [(r.name, r.cell, None if r.low is None else float(r.low), None if r.high is None else float(r.high), True) for r in rules]
    table = values.sparkSession.createDataFrame(rows, "rule string, cell string, low double, high double, ruled boolean")
    names = sorted({r.name for r in rules})
    both = values.where(F.col("rule").isin(names)).join(table, ["rule", "cell"], "full_outer")
    value = F.coalesce("value", F.lit(0.0))
    # A cell that no rule lists may hold nothing.
    high = F.when(F.col("ruled"), F.col("high")).otherwise(F.lit(0.0))
    met = (F.col("low").isNull() | (value >= F.col("low"))) & (high.isNull() | (value <= high))
    return both.select("rule", "cell", "low", high.alias("high"), value.alias("value"), met.alias("met"))


def violations(frame: DataFrame, rules: Sequence[Rule], columns: Sequence[str]) -> DataFrame:
    """The rules that a raw log table breaks; no rows when the contract holds."""
    return checked(log_values(frame, columns), rules).where("NOT met")
