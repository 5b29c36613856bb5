"""Datasets, runs and analyses under one root folder."""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.sources import readers, writers


def as_json(value: Any) -> str:
    """JSON text in which not-a-number and infinity are null and times ISO text."""
    lenient = json.dumps(value, default=lambda other: other.isoformat() if hasattr(other, "isoformat") else str(other))
    # The parser meets the three non-standard constants only as whole tokens, never inside strings.
    return json.dumps(json.loads(lenient, parse_constant=lambda _: None), allow_nan=False)


def utc_now() -> str:
    return datetime.now(timezone.utc).isoformat()


class Store:
    """Parquet tables and one-record JSON files; `root` must be readable by every executor."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def path(self, *parts: str) -> str:
        return os.path.join(self.root, *parts)

    def _record(self, kind: str, key: str) -> dict:
        try:
            rows = self.spark.read.text(self.path(kind, key, "record")).limit(1).collect()
        except AnalysisException as error:
            raise ValueError(f"Nothing is stored as {key!r} under {kind}.") from error
        return json.loads(rows[0]["value"])

    def _save_record(self, kind: str, key: str, record: dict) -> None:
        writers.write_record(self.spark, as_json(record), self.path(kind, key, "record"))

    def _records(self, kind: str) -> DataFrame:
        """All records of a kind as rows, schema from the records themselves."""
        return self.spark.read.json(self.path(kind, "*", "record"))

    def save_dataset(self, key: str, frame: DataFrame, context: DataFrame) -> None:
        frame.write.parquet(self.path("datasets", key, "rows"))
        described = context.select(F.to_json(F.struct("*")).alias("v")).first()["v"]
        self._save_record("datasets", key, {**json.loads(described), "id": key, "created_at": utc_now()})

    def dataset(self, key: str) -> tuple[DataFrame, dict]:
        record = self._record("datasets", key)
        return self.spark.read.parquet(self.path("datasets", key, "rows")), record

    def save_run(self, key: str, record: dict, evidence: DataFrame, metrics: DataFrame, rows: DataFrame) -> None:
        writers.write_evidence(evidence, self.path("runs", key, "evidence"))
        writers.write_metrics(metrics, self.path("runs", key, "metrics"))
        writers.write_partitions(rows, self.path("runs", key, "partitions"))
        self._save_record("runs", key, {"id": key, "status": "completed", "created_at": utc_now(), **record})

    def run(self, key: str) -> dict:
        return self._record("runs", key)

    def runs(self) -> DataFrame:
        return self._records("runs")

    def evidence(self, key: str, model_id: str | None = None) -> DataFrame:
        record = self.run(key)
        wanted = model_id or record["recommended_model_id"]
        if wanted not in {r["model_id"] for r in record["results"]}:
            raise ValueError("The run has saved no evidence of that model.")
        return readers.read_evidence(self.spark, self.path("runs", key, "evidence"), wanted)

    def partitions(self, key: str) -> DataFrame:
        return self.spark.read.parquet(self.path("runs", key, "partitions"))

    def save_analysis(self, key: str, rows: DataFrame, record: dict) -> None:
        rows.write.parquet(self.path("analyses", key, "rows"))
        self._save_record("analyses", key, {"id": key, "created_at": utc_now(), **record})

    def analysis(self, key: str) -> tuple[DataFrame, dict]:
        record = self._record("analyses", key)
        return self.spark.read.parquet(self.path("analyses", key, "rows")), record

    def analyses(self) -> DataFrame:
        return self._records("analyses")

    def export(self, key: str, kind: str, path: str, model_id: str | None = None) -> None:
        if kind == "metrics":
            source = readers.read_csv_strings(self.spark, self.path("runs", key, "metrics"))
        else:
            source = self.evidence(key, model_id)
            model_id = model_id or self.run(key)["recommended_model_id"]
        writers.export_csv(source, path, kind, model_id)
