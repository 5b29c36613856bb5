"""Label, split, time and outcome expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logtide.functions.text import as_string, is_blank, strip

# --- fixed values ---------------------------------------------------------------------------
NORMAL_WORDS = ("normal", "benign")
ABNORMAL_WORDS = ("abnormal", "anomalous", "anomaly")
PARTITIONS = ("train", "validation", "test")
VALIDATION_ALIASES = ("val", "valid", "dev")
TAG_ANOMALY = ("1", "abnormal", "anomaly", "anomalous", "true")
TAG_NORMAL = ("0", "normal", "false")
OUTCOMES = ("TP", "FP", "FN", "TN")
# -------------------------------------------------------------------------------------------

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"
# Dates by shape (a four-digit number is Y, another number 9, letters a) and the one or two patterns of each; months come
# before days unless only the other order is a date.
_DATES = {
    "9/9/Y": ("M/d/yyyy", "d/M/yyyy"),
    "9/9/9": ("M/d/yy", "d/M/yy"),
    "Y/9/9": ("yyyy/M/d",),
    "9-9-Y": ("M-d-yyyy", "d-M-yyyy"),
    "Y-9-9": ("yyyy-M-d",),
    "9.9.Y": ("M.d.yyyy", "d.M.yyyy"),
    "Y.9.9": ("yyyy.M.d",),
    "a 9, Y": ("MMM d, yyyy", "MMMM d, yyyy"),
    "a 9 Y": ("MMM d yyyy", "MMMM d yyyy"),
    "9 a Y": ("d MMM yyyy", "d MMMM yyyy"),
    "9 a, Y": ("d MMM, yyyy", "d MMMM, yyyy"),
    "Y a 9": ("yyyy MMM d", "yyyy MMMM d"),
    "9-a-Y": ("d-MMM-yyyy", "d-MMMM-yyyy"),
    "9-a-9": ("d-MMM-yy",),
    "9": ("yyyyMMdd",),
}
_CLOCK, _CLOCK_HALVES = " H:mm[:ss[.SSSSSSSSS]][ ][XXX][XX]", " h:mm[:ss] a"


def binary_label(value: Column) -> Column:
    """0, 1 or null. Blank is null; use `binary_label_invalid` to find values that are neither."""
    token = F.lower(as_string(value))
    number = F.when(token.rlike(_NUMBER), token.try_cast("double"))
    return (
        F.when(token.isin(*NORMAL_WORDS), F.lit(0))
        .when(token.isin(*ABNORMAL_WORDS), F.lit(1))
        .when(number == 0.0, F.lit(0))
        .when(number == 1.0, F.lit(1))
    ).cast("int")


def binary_label_invalid(value: Column) -> Column:
    return ~is_blank(value) & binary_label(value).isNull()


def strict_label(value: Column) -> Column:
    """normal/abnormal only; anything else is null."""
    return F.when(value == "normal", F.lit(0)).when(value == "abnormal", F.lit(1)).cast("int")


def label_tag(value: Column) -> Column:
    token = F.lower(F.coalesce(value.cast("string"), F.lit("")))
    return F.when(token.isin(*TAG_ANOMALY), "Anomaly").when(token.isin(*TAG_NORMAL), "Normal").otherwise("Unlabelled")


def split_name(value: Column) -> Column:
    token = F.lower(as_string(value))
    return F.when(token.isin(*VALIDATION_ALIASES), F.lit("validation")).otherwise(token)


def tolerant_timestamp(value: Column) -> Column:
    """UTC timestamp in any of the accepted notations, null when none fits.

    The shape of a date, not a chain of attempts, picks the one or two patterns that it is read with.
    """
    text = strip(value.cast("string"))
    plain = F.regexp_replace(text, r"^(?i)(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", "")
    parts = r"^(.*?)(?:[T,\s]+(\d{1,2}:\d{2}.*))?$"
    date, clock = F.regexp_extract(plain, parts, 1), F.regexp_extract(plain, parts, 2)
    clock = F.regexp_replace(clock, r"(?i)\s*(utc|gmt)$", "Z")
    letters = F.regexp_replace(date, r"[A-Za-z]+", "a")
    shape = F.regexp_replace(F.regexp_replace(letters, r"(?<!\d)\d{4}(?!\d)", "Y"), r"\d+", "9")
    halves = clock.rlike(r"(?i)[ap]m$")
    spaced = F.when(halves, F.regexp_replace(clock, r"(?i)\s*([ap]m)$", " $1")).otherwise(clock)
    whole = F.when(clock == "", date).otherwise(F.concat(date, F.lit(" "), spaced))
    ending = F.when(clock == "", "").when(halves, _CLOCK_HALVES).otherwise(_CLOCK)

    def read(place: int) -> Column:
        patterns = [F.lit(x) for shape_, found in _DATES.items() if len(found) > place for x in (shape_, found[place])]
        return F.try_to_timestamp(whole, F.concat(F.element_at(F.create_map(*patterns), shape), ending))

    return F.coalesce(F.try_to_timestamp(text), read(0), read(1))


def strict_timestamp(value: Column) -> Column:
    """Raises when the job meets a value that is not a timestamp."""
    return value.cast("timestamp")


def predicted(score: Column, threshold: Column) -> Column:
    return (score >= threshold).cast("int")


def confidence(score: Column, prediction: Column) -> Column:
    return F.when(prediction == 1, score).otherwise(1 - score)


def outcome(actual: Column, prediction: Column) -> Column:
    """TP/FP/FN/TN; null when the truth is unknown."""
    return (
        F.when((actual == 1) & (prediction == 1), "TP")
        .when((actual == 0) & (prediction == 1), "FP")
        .when((actual == 1) & (prediction == 0), "FN")
        .when((actual == 0) & (prediction == 0), "TN")
    )


def finite_or_null(value: Column) -> Column:
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def iso_time(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
