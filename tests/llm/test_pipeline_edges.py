"""The pipeline's stages on rows with nulls, very long and repeated texts, ties and clashing column names."""

import gc
import weakref

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logtide.llm import bpe, common, language, mixing, quality

OWN = ("_lang", "_source", "_topic", "_tokens", "_probability", "_kept", "__quality", "__name", "__sure", "score", "label", "w")


@pytest.fixture(scope="module")
def odd(spark, folder):
    """Rows of the table and odd ones, with further columns named like those that operators add."""
    docs = corpus_pipeline.table(spark, folder, "documents").limit(60)
    plain = docs.where("text IS NOT NULL AND lang IS NOT NULL").orderBy("doc_id").limit(1)
    long = plain.withColumns({"doc_id": F.lit(900_001).cast("bigint"), "text": F.repeat(F.concat("text", F.lit(" ")), 400)})
    empty = [plain.withColumns({"doc_id": F.lit(i).cast("bigint"), "text": F.lit(t).cast("string")}) for i, t in [(900_002, None), (900_003, ""), (900_004, " 1 ")]]
    nothing = docs.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
    rows = docs.union(plain).union(long).union(nothing).union(nothing)
    for more in empty:
        rows = rows.union(more)
    return common.replaced(rows.withColumns({name: F.lit(f"mine {name}") for name in OWN}), "odd")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_keeps_own_columns_of_odd_rows(spark, folder, odd, name, stage):
    made = common.replaced(stage(spark, odd, folder), f"edge-{name}")
    if name == "tokens":
        assert made.count() == odd.count()
        return
    assert made.columns == odd.columns
    assert made.exceptAll(odd).count() == 0 and made.count() > 0
    assert {tuple(r) for r in made.select(*OWN).distinct().collect()} == {tuple(f"mine {c}" for c in OWN)}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_of_no_rows_keeps_columns(spark, folder, odd, name, stage):
    made = stage(spark, odd.limit(0), folder)
    assert made.count() == 0 and (name == "tokens" or made.columns == odd.columns)


def test_operators_leave_clashing_columns(spark, odd):
    named = language.with_language(odd, language.fit(odd), "found", "sure")
    assert named.drop("found", "sure").exceptAll(odd).count() == 0 and named.count() == odd.count()
    assert mixing.kept(odd).exceptAll(odd).count() == 0


def test_contradictory_labels_and_ties(spark):
    docs = spark.createDataFrame([(i, "same words here" if i < 40 else "OTHER 123!!") for i in range(80)], "doc_id bigint, text string")
    marks = [(i, int(i >= 40)) for i in range(80)] + [(5, 1), (50, 0)]
    models = [quality.fit(docs, spark.createDataFrame(rows, "doc_id bigint, quality int")) for rows in (marks, marks[::-1])]
    assert models[0].labels.tolist() == models[1].labels.tolist() and models[0].labels.sum() == 39
    same = quality.Model(models[0].projection, models[0].vectors[[0] * 60], (quality.np.arange(60) < 10).astype(float), 20)
    assert same.scores(["same words here"]).tolist() == pytest.approx([0.5])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_begins_by_freeing_what_is_left(spark, folder, odd, name, stage):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()

    def collections():
        """Whole collections of the heap, which let Spark drop broadcasts that nothing refers to."""
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    class Left:
        pass

    gc.collect()
    gc.disable()
    try:
        left = Left()
        left.me, seen, before = left, weakref.ref(left), collections()
        del left
        shared = spark.sparkContext.broadcast([1])
        made = odd.limit(3).select("doc_id").mapInArrow(lambda batches: (b for b in batches if shared.value), "doc_id bigint")
        stage(spark, odd.limit(0), folder)
        assert seen() is None and collections() > before
    finally:
        gc.enable()
    # What a frame still needs stays.
    assert made.count() == 3


def test_tokens_stage_folds_the_words_of_all_documents(spark, folder, odd, monkeypatch):
    expected = {tuple(r) for r in corpus_pipeline.tokenize(spark, odd, folder).collect()}
    ahead = bpe.frequent_words
    def refused(*_):
        raise AssertionError("a word of ordinary length was merged outside the fold")

    monkeypatch.setattr(bpe, "merged", refused)
    monkeypatch.setattr(bpe, "frequent_words", lambda *given: ahead(*given).limit(0))
    assert {tuple(r) for r in corpus_pipeline.tokenize(spark, odd, folder).collect()} == expected
