"""Scans: CSV, text and JSON uploads, the cleaned table, saved results and stored evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as types

from logtide.operators.prepare import CLEANED_COLUMNS, require_columns
from logtide.runtime import new_path, stored
from logtide.sources import slices

_BOM = "\ufeff"
_NESTED = ("array", "map", "struct")
# Vertical tab, form feed and the Unicode line and paragraph separators also end a line.
_LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """CSV, TXT or JSON by suffix."""
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    readers = {"csv": read_csv_strings, "txt": read_lines, "json": read_json_logs}
    if suffix not in readers:
        raise ValueError("An upload is a .csv, .txt or .json file.")
    frame = readers[suffix](spark, path)
    if frame.isEmpty():
        raise ValueError("The upload is empty: it has no rows.")
    return frame


def read_csv_strings(spark: SparkSession, path: str, multi_line: bool = True, position: str | None = None) -> DataFrame:
    """All columns as text, empty cells as ''; a record with more or fewer cells than the header is refused.

    Records with line breaks in quotes are found by many tasks, however large a file is. Set `multi_line` off to skip
    that for files without such breaks. `position` names a column for the place of a record over all files, from 1.
    """
    head = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"')
    names = [name.removeprefix(_BOM) for name in head.columns]
    pieces = slices.pieces(spark, path, "\n")
    found = slices.records(pieces, slices.CSV)[0] if multi_line else slices.lines(pieces)
    if position is not None:
        found = slices.numbered(found, spark, path, position, headers=1)
    # The first record of each file is its header.
    rows = found.where("block <> 0 OR place <> 0").withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    kept = [] if position is None else [position]
    cells = ", ".join(f"c{i} string" for i in range(len(names))) + ", ragged string"
    options = {"quote": '"', "escape": '"', "columnNameOfCorruptRecord": "ragged", "multiLine": "true"}
    parsed = rows.select(*kept, "record", F.from_csv("record", cells, options).alias("cells"))
    message = F.concat(F.lit(f"A record does not have the {len(names)} cells of the header: "), F.substring("record", 1, 200))
    whole = parsed.where(F.when(F.col("cells.ragged").isNull(), True).otherwise(F.raise_error(message).cast("boolean")))
    texts = [F.coalesce(F.col(f"cells.c{i}"), F.lit("")) for i in range(len(names))]
    return whole.select(*kept, *texts).toDF(*kept, *names)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One message per non-blank line."""
    lines = spark.read.text(path).select(F.explode(F.split("value", _LINE_ENDS)).alias("log_text"))
    cleaned = lines.select(F.regexp_replace("log_text", "^" + _BOM, "").alias("log_text"))
    return cleaned.where(~F.col("log_text").rlike(r"(?U)^\s*$"))


_SHAPE = "A JSON upload is a list of logs with at least one entry, or an object that starts with or holds one as 'logs'."
_KIND = "Entries of a JSON upload are strings throughout or objects throughout."


def read_json_logs(spark: SparkSession, path: str) -> DataFrame:
    """A list of messages, a list of flat objects, or either under `logs`.

    A document is cut at the elements of its list by many tasks, as long as the list comes first in it; one with other
    fields before `logs` is read by one task.
    """
    found = slices.pieces(spark, path, ",")
    ends = slices.block_ends(found, slices.json_list(1))
    blank = r"^[\s\x{FEFF}]*"
    shape = F.when(F.col("head").rlike(blank + r"\["), 1).when(F.col("head").rlike(blank + r"\{\s*\"logs\"\s*:\s*\["), 2)
    shape = shape.when(F.col("head").rlike(blank + r"\{"), 3).otherwise(0)
    shapes = [row[0] for row in ends.where("block = 0").select(shape.alias("shape")).distinct().limit(4).collect()]
    if len(shapes) != 1 or shapes[0] == 0:
        raise ValueError(_SHAPE)
    if shapes[0] == 3:
        return _logs_field(spark, path)
    elements, starts = slices.records(found, slices.json_list(shapes[0]), shapes[0], ends)
    if not starts.where("last AND (inside OR depth <> 0 OR NOT closed)").isEmpty():
        raise ValueError(_SHAPE)
    # A list without elements is one blank record.
    trimmed = elements.select(F.regexp_replace("record", r"[\r\n]+", " ").alias("value")).select(F.trim("value").alias("value"))
    rows = stored(trimmed.where("value <> ''"), "elements")
    kinds = rows.agg(F.count(F.lit(1)), F.count_if(F.col("value").startswith('"')), F.count_if(F.col("value").startswith("{"))).first()
    if kinds[0] == 0:
        raise ValueError(_SHAPE)
    if kinds[0] == kinds[1]:
        listed = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>", {"mode": "FAILFAST"})
        return rows.select(F.element_at(listed, 1).alias("log_text"))
    if kinds[0] != kinds[2]:
        raise ValueError(_KIND)
    lines = new_path(spark, "json-lines")
    rows.write.text(lines)
    return _flat(spark.read.json(lines))


def _logs_field(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True)
    document = spark.read.json(path, multiLine=True)
    field = next((f for f in document.schema.fields if f.name == "logs"), None)
    if field is None or not isinstance(field.dataType, types.ArrayType):
        raise ValueError(_SHAPE)
    if isinstance(field.dataType.elementType, types.StructType):
        return _flat(document.select(F.explode("logs").alias("e")).select("e.*"))
    return _messages(whole, F.to_json(F.from_json("value", "struct<logs:array<variant>>")["logs"]))


def _messages(whole: DataFrame, value) -> DataFrame:
    kinds = whole.select(F.schema_of_variant(F.parse_json(value)).alias("s")).distinct().limit(2).collect()
    if {row["s"] for row in kinds} != {"ARRAY<STRING>"}:
        raise ValueError(_KIND)
    return whole.select(F.explode(F.from_json(value, "array<string>")).alias("log_text"))


def _flat(frame: DataFrame) -> DataFrame:
    if "_corrupt_record" in frame.columns:
        raise ValueError(_KIND)
    nested = [f.name for f in frame.schema.fields if f.dataType.typeName() in _NESTED]
    if nested:
        raise ValueError("Fields of a JSON entry hold one scalar each, no lists or objects.")
    return frame


def read_cleaned(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The typed cleaned table from CSV: strict times, integer target, null text as ''."""
    raw = require_columns(read_csv_strings(spark, path, multi_line), CLEANED_COLUMNS)
    return raw.withColumns(
        {"timestamp": F.col("timestamp").cast("timestamp"), "target": F.col("target").cast("int")}
    ).orderBy("timestamp", "session_id")


def read_saved_results(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a saved results document with `groups.logs[]` and `groups.sessions[]`."""
    document = spark.read.json(path, multiLine=True)
    parts = [
        document.select("source", F.explode(f"groups.{group}").alias("r")).select("r.*", "source")
        for group in ("logs", "sessions")
    ]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def read_evidence(spark: SparkSession, path: str, model_id: str) -> DataFrame:
    """Stored evidence of one model; only its partition folder is read."""
    return spark.read.parquet(path).where(F.col("model_id") == model_id)


def file_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) per written file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


# Fixed value: a prime that sums of row hashes are taken by.
_PRIME = (1 << 61) - 1


def content_fingerprint(frame: DataFrame) -> DataFrame:
    """Row count and an order-free hash of all rows, the same however the output is cut into files.

    Two keyed hashes of each row are summed modulo a prime, so that a row counts as often as it stands there. Which cells
    are null is part of a row. Fingerprints of parts can be added up.
    """
    nulls = F.concat(F.lit(""), *[F.when(F.col(c).isNull(), "1").otherwise("0") for c in frame.columns])
    sums = [F.sum(F.pmod(F.xxhash64(F.lit(key), nulls, *frame.columns), F.lit(_PRIME)).cast("decimal(38,0)")) for key in ("first", "second")]
    digits = [F.lpad(F.hex(F.pmod(F.coalesce(s, F.lit(0)), F.lit(_PRIME).cast("decimal(38,0)")).cast("bigint")), 16, "0") for s in sums]
    return frame.agg(F.count(F.lit(1)).alias("rows"), F.concat(*digits).alias("fingerprint"))
