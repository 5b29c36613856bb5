"""Time notations against pandas, and fingerprints of rows that repeat or hold nulls."""

import pandas as pd
from pyspark.sql import functions as F

from logtide.functions import labels as L
from logtide.operators import audit
from logtide.sources.readers import content_fingerprint

NOTATIONS = """1/2/2024|01/02/2024|13/02/2024|02/13/2024|1/2/24|2024/01/02|2024/1/2 3:04|2024-01-02|2024-01-02 03:04|2024-01-02T03:04:05Z
2024-01-02T03:04:05.678Z|2024-01-02 03:04:05.678901|2024-01-02T03:04:05+02:00|01/02/2024 03:04|01/02/2024 03:04:05|1/2/2024 3:04:05 PM|1/2/2024 3:04 am
Jan 2, 2024|January 2, 2024|Jan 2 2024|Jan 2, 2024 03:04:05|January 2, 2024 11:04 PM|2 Jan 2024|2 January 2024|02 Jan 2024 03:04:05|02-Jan-2024
02-Jan-2024 03:04|2-Jan-24|2024/01/02 03:04:05.678|20240102|Tue, 02 Jan 2024 03:04:05 +0000|Tue, 02 Jan 2024 03:04:05 GMT|2024.01.02|01.02.2024
13.02.2024 03:04|1-2-2024|2024 Jan 2|not a time|99/99/2024|2024-13-45|JAN 2, 2024|2 jan 2024 3:04 pm""".replace("\n", "|").split("|")


def test_notations_as_pandas_reads_them(spark):
    frame = spark.createDataFrame([(n,) for n in NOTATIONS], "v string")
    found = {r["v"]: r["t"] for r in frame.select("v", F.date_format(L.tolerant_timestamp(F.col("v")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t")).collect()}
    wanted = pd.to_datetime(pd.Series(NOTATIONS), errors="coerce", utc=True, format="mixed")
    shown = [None if pd.isna(t) else t.strftime("%Y-%m-%d %H:%M:%S.%f") for t in wanted]
    assert len(NOTATIONS) >= 40
    assert {n: found[n] for n in NOTATIONS} == dict(zip(NOTATIONS, shown, strict=True))


def _print(spark, rows, schema="a int, b string"):
    return content_fingerprint(spark.createDataFrame(rows, schema)).first()["fingerprint"]


def test_fingerprints_count_repeated_rows_and_nulls(spark):
    pairs = [(1, "x"), (1, "x"), (3, "y")]
    assert _print(spark, pairs) != _print(spark, [(2, "x"), (2, "x"), (3, "y")])
    assert _print(spark, pairs) == _print(spark, pairs[::-1]) != _print(spark, pairs[1:])
    assert _print(spark, [(1, None), (None, "1")]) != _print(spark, [(None, None), (1, "1")])
    assert len(_print(spark, [])) == 32 and _print(spark, []) != _print(spark, [(None, None)])


def test_values_are_counted_without_their_blanks(spark):
    frame = spark.createDataFrame([("AMF",), (" AMF",), ("AMF ",), ("UPF",), (" ",), (None,)], "nf string")
    assert [tuple(r) for r in audit.value_counts(frame, "nf").collect()] == [("AMF", 3), ("UPF", 1)]


def test_cells_for_display(spark):
    from logtide.functions import text as T

    frame = spark.createDataFrame([("a_b_c",), ("x" * 201,), (None,), ("é" * 200,)], "v string")
    rows = [tuple(r) for r in frame.select(T.clip(F.col("v")), T.clip(F.col("v"), 2), T.prettified(F.col("v"))).collect()]
    assert rows[0] == ("a_b_c", "a_…", "a b c") and rows[1][0] == "x" * 200 + "…" and rows[2] == ("", "", "") and rows[3][0] == "é" * 200


def test_groups_outside_their_bounds_are_refused(spark):
    import pytest

    from logtide.operators import allocate

    frame = spark.createDataFrame([(i, "a") for i in range(40)] + [(100 + i, "b") for i in range(2)], "id bigint, s string")
    assert allocate.fixed_size_groups(frame, "s", "id").count() == 42
    assert allocate.fixed_size_groups(frame.where("s = 'a'"), "s", "id", bounds=(3, 9)).count() == 40
    with pytest.raises(Exception, match="stratum of 2 rows"):
        allocate.fixed_size_groups(frame, "s", "id", bounds=(3, 9)).collect()
