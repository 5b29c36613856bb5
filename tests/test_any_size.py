"""Operators that once refused large inputs."""

from pyspark.sql import functions as F

from logtide.operators import audit
from logtide.plans import catalog_features


def test_value_lists_of_many_values(spark):
    frame = spark.range(1_500).select(F.concat(F.lit("v"), "id").alias("name"), F.lit(None).cast("string").alias("none"))
    lists = {r["column"]: r["values"] for r in audit.value_lists(frame, ["name", "none"]).collect()}
    assert lists == {"name": sorted(f"v{i}" for i in range(1_500)), "none": []}
    assert {(r["column"], r["value"]) for r in audit.value_rows(frame, ["name"]).collect()} == {("name", f"v{i}") for i in range(1_500)}


def test_row_wise_means_with_a_large_vocabulary(spark, folder, monkeypatch):
    wanted = {tuple(r) for r in catalog_features.row_wise_mean_embedding(spark, folder).collect()}
    small = catalog_features._token_vectors
    more = spark.range(200_001).select(
        F.concat(F.lit("no such token "), "id").alias("token"), F.array(*[F.lit(0.5)] * 4).alias("vector"), F.lit(1.0).alias("weight")
    )
    monkeypatch.setattr(catalog_features, "_token_vectors", lambda tokens: small(tokens).unionByName(more))
    assert wanted and {tuple(r) for r in catalog_features.row_wise_mean_embedding(spark, folder).collect()} == wanted
