"""Sinks: cleaned and raw tables, evidence, metrics, partitions and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.operators.prepare import CLEANED_COLUMNS, RAW_COLUMNS

EVIDENCE_COLUMNS = (
    "model_id", "row_id", "unit_id", "log_text", "session_id", "known_anomaly_type", "event_count",
    "score", "predicted", "confidence", "threshold", "actual", "outcome",
)


def _write(frame: DataFrame, path: str, form: str, mode: str = "errorifexists") -> None:
    writer = frame.write.mode(mode)
    if form == "csv":
        writer.csv(path, header=True, quote='"', escape='"', emptyValue="")
    else:
        writer.format(form).save(path)


def write_cleaned(frame: DataFrame, path: str, form: str = "parquet") -> None:
    _write(frame.select(*CLEANED_COLUMNS), path, form)


def write_raw(frame: DataFrame, path: str, form: str = "csv") -> None:
    _write(frame.select(*RAW_COLUMNS), path, form)


def write_evidence(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per configuration, so that one model's evidence is read alone."""
    rows.select(*EVIDENCE_COLUMNS).write.mode(mode).partitionBy("model_id").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    _write(metrics.drop("confusion_matrix"), path, "csv")


def write_partitions(frame: DataFrame, path: str) -> None:
    _write(frame.select("row_id", "_split"), path, "parquet")


def write_record(spark: SparkSession, record_json: str, path: str) -> None:
    """One JSON record. The committer publishes the folder only when the write is complete."""
    spark.createDataFrame([(record_json,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def export_csv(source: DataFrame, path: str, kind: str, model_id: str | None = None) -> None:
    if kind not in ("metrics", "predictions"):
        raise ValueError(f"An export is of kind 'metrics' or 'predictions', not {kind!r}.")
    if kind == "metrics":
        write_metrics(source, path)
    else:
        _write(source.where(F.col("model_id") == model_id), path, "csv")
