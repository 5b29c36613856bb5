"""Registered queries: a Spark callable each, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


_ENTRIES: dict[str, Entry] = {}
_AREAS = ("sources", "projections", "joins", "audits", "sessions", "features", "scoring", "serving")


def register(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers the decorated function under its own name."""

    def add(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return function(spark, folder)

        _ENTRIES[function.__name__] = Entry(run, sql)
        return function

    return add


def entries() -> dict[str, Entry]:
    for area in _AREAS:
        importlib.import_module(f"logtide.plans.catalog_{area}")
    return dict(_ENTRIES)
