"""Runs a registered query and its SQL on the same tables and compares rows."""

from __future__ import annotations

import datetime
import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, int):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def _normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, db, name, entry, folder):
    """(seconds, rows, problem) of one query; problem is '' when both sides agree."""
    started = time.time()
    frame = entry.run(spark, folder)
    rows = [tuple(row) for row in frame.collect()]
    seconds = time.time() - started
    if entry.sql is None:
        return seconds, len(rows), ""
    started = time.time()
    cursor = db.execute(entry.sql)
    wanted = cursor.fetchall()
    took = time.time() - started
    names, left = _normal(frame.columns, rows)
    expected, right = _normal([c[0] for c in cursor.description], wanted)
    if names != expected:
        return seconds, len(rows), f"columns {names} <> {expected}"
    if len(left) != len(right):
        return seconds, len(rows), f"rows {len(left)} <> {len(right)}"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        return seconds, len(rows), f"{len(wrong)} rows differ, first {wrong[0]}"
    return seconds, len(rows), "" if took < 60 else f"slow SQL {took:.0f}s"
