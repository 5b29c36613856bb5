"""Steps that read their input once, and lookups of few keys that do not gather all rows in as few tasks."""

from pyspark.sql import functions as F

from logtide.functions import text as T
from logtide.operators import context, embed, prepare, units
from logtide.plans import catalog
from logtide.plans import views as V
from logtide.runtime import spread


def _plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_session_logs_read_prepared_rows_once(spark, folder):
    labelled = V.session_logs(spark, folder)
    assert not any(name.endswith("events.parquet") for name in labelled.inputFiles())
    assert labelled.count() == V.prepared_logs(spark, folder).count()


def test_repeated_rows_are_not_hashed_again(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "row_id bigint, v string")
    unique = prepare.first_of_duplicates(frame, ["v"])
    assert sorted(row["row_id"] for row in unique.collect()) == [1, 3, 4]
    # The hashes that repeat are read where they were written, one grouping is left: that of the suspects.
    assert unique.inputFiles()
    assert _plan(unique).count("HashAggregate") <= 4


def test_few_texts_are_broadcast_not_shuffled(spark):
    rows = [(i, ("up down", "down left up", "")[i % 3]) for i in range(30)]
    built = units.log_units(spark.createDataFrame(rows, "row_id bigint, _text string"))
    words = [("up", [1.0, 0.0], 1.0), ("down", [0.0, 1.0], 2.0)]
    table = embed.WordTable(spark.createDataFrame(words, "word string, vector array<double>, weight double"), 2, 2)
    found = embed.text_embeddings(built, table)
    assert "BroadcastHashJoin" in _plan(found) and "SortMergeJoin" not in _plan(found)
    means = {row["unit_id"]: (row["mean"], row["weighted"]) for row in found.collect()}
    assert len(means) == 30
    assert means["0"] == ([0.5, 0.5], [1 / 3, 2 / 3]) and means["2"] == ([0.0, 0.0], [0.0, 0.0])


def test_few_contexts_are_broadcast(spark):
    seen = [("a", 1, 4, 5, 2), ("a", 4, 5, 0, 1), ("b", 1, 4, 5, 1)]
    found = spark.createDataFrame(seen, "unit_id string, previous int, key int, following int, n bigint")
    told = context.surprise(found, context.fit_contexts(found, 3))
    assert "BroadcastHashJoin" in _plan(told) and "SortMergeJoin" not in _plan(told)
    assert {row["unit_id"]: row["events"] for row in told.collect()} == {"a": 3, "b": 1}


def test_spread_keeps_every_row(spark):
    one = spark.range(1000).coalesce(1)
    dealt = spread(one)
    assert dealt.rdd.getNumPartitions() >= min(2, spark.sparkContext.defaultParallelism)
    assert dealt.agg(F.count("id"), F.sum("id")).first()[:] == (1000, 499500)


def test_distinct_texts_are_cleaned_once(spark, folder):
    for name in ("reuse_per_distinct_text", "distinct_value_counts", "group_class_counts"):
        found = catalog.entries()[name].run(spark, folder)
        assert found.inputFiles() and not any(x.endswith(("events.parquet", "documents.parquet")) for x in found.inputFiles()), name


def test_symbols_of_any_script_become_blanks(spark):
    texts = ["Größe=5 µs; ÅNGSTRÖM \u212a \u0130 \u017f", "a_b-c [X] \t  {1}", "٣ ünter-x, Z\x00", ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_replace(F.lower("t"), r"(?U)\d(?<=\b\d)\d*(?:\.\d+)?\b", "num_value")
    ranges = F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9_\- ]+", " "), " {2,}", " ")
    rows = frame.select(T.clean_log_text(F.col("t")).alias("new"), F.trim(F.translate(ranges, "-", "_")).alias("old")).collect()
    assert [row["new"] for row in rows] == [row["old"] for row in rows]
