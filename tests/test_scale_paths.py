"""The paths hot keys and long groups take must give the plain result."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from logtide.operators import allocate, embed, events, lexical, scoring, skew, units


def test_salted_lookup_equals_plain_join(spark):
    facts = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 40).alias("k"))
    lookup = spark.range(35).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("left", "inner"):
        plain = {tuple(r) for r in facts.join(lookup, "k", how).select("id", "k", "v").collect()}
        salted = skew.salted_lookup(facts, lookup, "k", how, rows=100, shares=10).select("id", "k", "v").collect()
        assert len(salted) == len(plain) and {tuple(r) for r in salted} == plain
    assert skew.hot_keys(skew.key_sizes(facts, "k"), "k", 100, 10).count() == 1


def test_running_totals_equal_window(spark):
    rng = random.Random(3)
    rows = [(f"g{rng.randrange(3)}", rng.random() ** 6, i, rng.randrange(9)) for i in range(800)]
    frame = spark.createDataFrame(rows, "g string, score double, i int, v bigint")
    exponent, mantissa = skew.score_digits(F.col("score"))
    cells = frame.withColumn("a", exponent).withColumn("b", mantissa)
    order = [F.col("score"), F.col("i")]
    found = skew.running_totals(cells, ["g"], ["a", "b"], order, ["v"])
    window = Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = frame.select("i", F.sum("v").over(window).alias("c"), F.sum("v").over(Window.partitionBy("g")).alias("t"))
    assert {(r.i, r.cum_v, r.total_v) for r in found.collect()} == {tuple(r) for r in wanted.collect()}


def test_score_digits_keep_order(spark):
    values = [0.0, 5e-324, 1e-310, 1e-30, 1e-12, 0.1, 0.25, 0.2500001, 0.4999999999999999, 0.5, 0.75, 1.0]
    frame = spark.createDataFrame([(v,) for v in values], "s double")
    exponent, mantissa = skew.score_digits(F.col("s"))
    rows = frame.select("s", exponent.alias("a"), mantissa.alias("b")).orderBy("s").collect()
    keys = [(r.a, r.b) for r in rows]
    assert keys == sorted(keys)


@pytest.mark.parametrize("limit", [1, 7, 10**6])
def test_positions_with_null_times(spark, limit):
    rng = random.Random(5)
    rows = [(i, f"g{i % 4 if i % 3 else 0}", None if rng.random() < 0.1 else rng.randrange(50)) for i in range(400)]
    frame = spark.createDataFrame(rows, "row_id bigint, g string, s int").withColumn("t", F.timestamp_seconds("s"))
    found = {r.row_id: r.position for r in skew.positions(frame, "g", "t", limit=limit).collect()}
    wanted, counters = {}, {}
    for i, g, s in sorted(rows, key=lambda r: (r[1], r[2] is None, r[2] or 0, r[0])):
        counters[g] = counters.get(g, 0) + 1
        wanted[i] = counters[g]
    assert found == wanted


def test_row_position_is_dense_after_sort(spark):
    frame = spark.range(1000).repartition(7).select((F.col("id") * 37 % 1000).alias("k"))
    rows = skew.with_row_position(frame, [F.col("k")]).collect()
    assert all(r.row_id == r.k + 1 for r in rows) and len(rows) == 1000


def _by_unit(frame, *columns):
    return {r.unit_id: tuple(r[c] for c in columns) for r in frame.collect()}


def test_segments_hold_the_whole_session(spark, prepared):
    frame = prepared.withColumn("_session", F.when(F.col("row_id") % 3 == 0, "hot").otherwise(F.col("_session")))
    whole = units.session_units(frame)
    cut = units.session_units(frame, limit=3)
    assert not whole.segmented and cut.segmented
    joined = (
        cut.frame.groupBy("unit_id")
        .agg(F.array_sort(F.collect_list(F.struct("segment", "_text", "log_keys", "row_ids"))).alias("s"), F.max("event_count").alias("n"), F.max("row_id").alias("row_id"))
        .select("unit_id", F.array_join(F.col("s._text"), " [EVENT] ").alias("_text"), F.flatten("s.log_keys").alias("log_keys"), F.flatten("s.row_ids").alias("row_ids"), "n", "row_id")
    )
    assert _by_unit(joined, "_text", "log_keys", "row_ids", "n", "row_id") == _by_unit(
        whole.frame.withColumn("n", F.col("event_count")), "_text", "log_keys", "row_ids", "n", "row_id"
    )
    assert cut.frame.agg(F.max(F.size("log_keys"))).first()[0] == 3


def test_segment_borders_do_not_show_in_features(spark, prepared, monkeypatch):
    frame = prepared.withColumn("_session", F.when(F.col("row_id") % 5 == 0, "hot").otherwise(F.col("_session")))
    whole, cut = units.session_units(frame), units.session_units(frame, limit=2)
    tf = [{(r.term, r.tf, r.df) for r in lexical.term_frequencies(u).collect()} for u in (whole, cut)]
    assert tf[0] == tf[1]
    lexicon = lexical.fit_lexicon(whole, 500)
    vectors = [{r.unit_id: r.tfidf for r in lexical.tfidf_vectors(u, lexicon).collect()} for u in (whole, cut)]
    assert vectors[0].keys() == vectors[1].keys()
    for key, vector in vectors[0].items():
        assert abs(vector.toArray() - vectors[1][key].toArray()).max() < 1e-9
    columns = ("unit_id", "position", "key", "previous", "following")
    seen = [
        {tuple(r[c] for c in columns) for r in events.session_events(u).collect()} for u in (whole, cut)
    ]
    assert seen[0] == seen[1]
    rows = [("T0-0", [0.0, 1.0], 1.0), ("T0-1", [2.0, 3.0], 2.0), ("T1-2", [4.0, 5.0], None)]
    table = spark.createDataFrame(rows, "word string, vector array<double>, weight double")
    means = []
    for numbers in (embed.HELD_NUMBERS, 0):
        monkeypatch.setattr(embed, "HELD_NUMBERS", numbers)
        means += [_by_unit(embed.session_embeddings(u, embed.WordTable(table, 2, 3)), "mean", "weighted") for u in (whole, cut)]
    for key, (mean, weighted) in means[0].items():
        for other in means[1:]:
            assert mean == pytest.approx(other[key][0]) and weighted == pytest.approx(other[key][1])


def test_masking_counts_and_repeatability(spark):
    rows = [(f"u{n}", 0, [f"k{i}" for i in range(n)], n) for n in (1, 2, 5, 15, 40)]
    frame = spark.createDataFrame(rows, "unit_id string, segment int, log_keys array<string>, event_count bigint")
    blank = F.lit(None).cast("string")
    frame = frame.select("*", blank.alias("lead_key"), blank.alias("trail_key"), F.lit(0).alias("_target"), blank.alias("_split"), F.lit(0).alias("offset"))
    base = events.session_events(units.Units(frame, "sessions"))
    sets = [
        {(r.unit_id, r.position) for r in events.masked_events(base, limit=n).where("masked").collect()} for n in (10**6, 3)
    ]
    assert sets[0] == sets[1]
    counts = {u: sum(1 for a, _ in sets[0] if a == u) for u, *_ in rows}
    assert counts == {"u1": 1, "u2": 1, "u5": 2, "u15": 4, "u40": 12}


def test_quotas_and_chunks(spark):
    frame = spark.range(1000).select("id", (F.col("id") % 2).cast("string").alias("s"))
    quotas = spark.createDataFrame([("0", "a", 200), ("0", "b", 300), ("1", "a", 499)], "s string, category string, count bigint")
    found = allocate.allocate_quotas(frame, quotas, "s", "id").groupBy("s", "category").count().collect()
    assert {(r.s, r.category): r["count"] for r in found} == {("0", "a"): 200, ("0", "b"): 300, ("1", "a"): 499, ("1", None): 1}
    chunks = allocate.fixed_size_groups(frame.where("id < 47"), "s", "id").groupBy("s", "chunk").count().collect()
    sizes = {s: sorted(r["count"] for r in chunks if r.s == s) for s in "01"}
    assert sizes == {"0": [6, 6, 6, 6], "1": [5, 6, 6, 6]}


def _f1_by_hand(pairs):
    best = None
    positives = sum(a for _, a in pairs)
    for t in sorted({s for s, _ in pairs}):
        tp = sum(a for s, a in pairs if s >= t)
        flagged = sum(1 for s, _ in pairs if s >= t)
        p, r = tp / flagged, tp / positives
        f1 = 2 * p * r / (p + r + 1e-12)
        if best is None or f1 > best[1]:
            best = (t, f1)
    return best


def test_threshold_and_areas_against_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for m in ("a", "b"):
        for i in range(300):
            y = int(rng.random() < 0.3)
            rows.append((m, i, round(min(1.0, max(0.0, rng.gauss(0.3 + 0.25 * y, 0.2))), 2), y))
    scores = spark.createDataFrame(rows, "model_id string, unit_id int, score double, actual int")
    curve = scoring.pr_curve(scoring.score_histogram(scores, ["model_id"]), ["model_id"])
    best = {r.model_id: (r.threshold, r.validation_f1) for r in scoring.best_thresholds(curve, ["model_id"]).collect()}
    ranks = {r.model_id: r for r in scoring.ranking_metrics(curve, ["model_id"]).collect()}
    for m in ("a", "b"):
        pairs = [(s, y) for k, _, s, y in rows if k == m]
        assert best[m] == pytest.approx(_f1_by_hand(pairs))
        pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
        auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert ranks[m].roc_auc == pytest.approx(auc)
        area, before = 0.0, 0
        for t in sorted({s for s, _ in pairs}, reverse=True):
            tp, flagged = sum(y for s, y in pairs if s >= t), sum(1 for s, _ in pairs if s >= t)
            area += (tp - before) / len(pos) * tp / flagged
            before = tp
        assert ranks[m].pr_auc == pytest.approx(area)


def test_ties_take_the_lowest_threshold_and_smallest_weight(spark):
    scores = spark.createDataFrame([("m", 1, 0.9, 1), ("m", 2, 0.5, 0), ("m", 3, 0.4, 1)], "model_id string, unit_id int, score double, actual int")
    curve = scoring.pr_curve(scoring.score_histogram(scores, ["model_id"]), ["model_id"])
    assert scoring.best_thresholds(curve, ["model_id"]).first().threshold == 0.4
    aligned = spark.createDataFrame([(1, 1, 0.9, 0.8), (2, 0, 0.1, 0.2)], "unit_id int, actual int, first double, second double")
    best = scoring.best_fusion(aligned).first()
    assert best.alpha == 0.0 and best.threshold == 0.8
    metrics = spark.createDataFrame([("x", 0.5, 2), ("y", 0.9, 3), ("z", 0.9, 1)], "model_id string, validation_f1 double, model_order int")
    assert scoring.recommended(metrics).first().recommended_model_id == "z"


def test_one_class_and_undefined_metrics(spark):
    scores = spark.createDataFrame([("m", 1, 0.9, 0), ("m", 2, 0.5, 0)], "model_id string, unit_id int, score double, actual int")
    ranks = scoring.ranking_metrics(scoring.pr_curve(scoring.score_histogram(scores, ["model_id"]), ["model_id"]), ["model_id"]).first()
    assert ranks.roc_auc is None and ranks.pr_auc is None
    rows = scoring.evidence(scores, F.lit(0.95))
    found = scoring.confusion_metrics(scoring.confusion(rows, ["model_id"])).first()
    assert (found.precision, found.recall, found.f1, found.fpr, found.accuracy) == (0.0, 0.0, 0.0, 0.0, 1.0)


def test_null_strata_keep_their_rows(spark):
    from logtide.operators.allocate import allocate_quotas, fixed_size_groups
    from logtide.operators.skew import positions

    rows = spark.range(30).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 > 0, F.lit("a")).alias("kind"))
    quotas = spark.createDataFrame([("a", "x", 5), (None, "y", 4)], "kind string, category string, count bigint")
    found = {(r["kind"], r["category"]): r["n"] for r in allocate_quotas(rows, quotas, "kind", "row_id").groupBy("kind", "category").agg(F.count("*").alias("n")).collect()}
    assert found == {("a", "x"): 5, ("a", None): 15, (None, "y"): 4, (None, None): 6}
    assert fixed_size_groups(rows, "kind", "row_id").count() == 30
    timed = rows.withColumn("at", F.col("row_id"))
    for limit in (100, 3):
        assert sorted(r["position"] for r in positions(timed, "kind", "at", limit=limit).where("kind IS NULL").collect()) == list(range(1, 11))


@pytest.mark.parametrize("numbers", [1_000, 0])
def test_every_event_counts_in_a_session_vector(spark, monkeypatch, numbers):
    import numpy as np

    from logtide.operators import embed
    from logtide.operators.units import Units

    monkeypatch.setattr(embed, "HELD_NUMBERS", numbers)
    vectors = spark.createDataFrame([("K1", [1.0, 0.0]), ("K2", [0.0, 1.0])], "word string, vector array<double>")
    known = spark.createDataFrame([("K1",), ("BAD",)], "word string")
    weights = spark.createDataFrame([("K1", 1.0), ("BAD", 2.0)], "word string, weight double")
    fitted = embed.word_table(embed.with_words(vectors, known, 2), weights, 2)
    rows = [("a", ["K1"]), ("b", ["K1", "BAD"]), ("c", ["BAD", "BAD"]), ("d", ["K1", "NEW"]), ("e", ["K1", "OTHER"]), ("f", [])]
    frame = spark.createDataFrame(rows, "unit_id string, log_keys array<string>")
    found = {r["unit_id"]: (r["mean"], r["weighted"]) for r in embed.session_embeddings(Units(frame, "sessions"), fitted).collect()}
    bad, unknown = embed.untrained("BAD", 2), embed.untrained(embed.UNKNOWN, 2)
    assert np.allclose(found["a"][0], [1, 0]) and np.allclose(found["c"][0], bad)
    assert np.allclose(found["b"][0], (np.array([1, 0]) + bad) / 2) and np.allclose(found["b"][1], (np.array([1, 0]) + 2 * bad) / 3)
    assert np.allclose(found["d"][0], (np.array([1, 0]) + unknown) / 2) and found["d"] == found["e"]
    assert found["f"][0] == [0.0, 0.0]


def test_long_sessions_show_their_whole_text(spark, prepared):
    from logtide.operators.units import session_units

    columns = ["unit_id", "log_text", "_text", "row_ids", "log_keys"]
    whole, cut = (sorted(map(tuple, session_units(prepared, limit).per_unit.select(*columns).collect())) for limit in (100, 3))
    assert whole == cut


def test_segments_are_cut_at_bytes_and_events(spark):
    rows = [(i, "big", f"k{i % 7}", i, "x" * (1 + i % 50)) for i in range(5_000)] + [(9_000 + i, f"s{i % 3}", "k", i, "y") for i in range(9)]
    frame = spark.createDataFrame(rows, "row_id bigint, _session string, _template string, t bigint, _text string").withColumn("_timestamp", F.timestamp_seconds("t"))
    built = units.session_units(frame, limit=100, limit_bytes=4_000)
    parts = sorted((r for r in built.frame.where("unit_id = 'big'").collect()), key=lambda r: r["segment"])
    assert [r["segment"] for r in parts] == list(range(len(parts))) and {r["segments"] for r in parts} == {len(parts)}
    sizes = [len(r["log_keys"]) for r in parts]
    assert max(sizes) <= 100 and [r["offset"] for r in parts] == [sum(sizes[:i]) for i in range(len(sizes))] and sum(sizes) == 5_000
    assert max(2 * sum(map(len, r["log_text"].split("\n"))) for r in parts) <= 4_000 + 100
    assert [k for r in parts for k in r["log_keys"]] == [f"k{i % 7}" for i in range(5_000)]
    assert {r["event_count"] for r in parts} == {5_000} and {r["text_bytes"] for r in parts} == {2 * sum(1 + i % 50 for i in range(5_000))}
    assert built.frame.where("segments = 1").count() == 3 == built.heads.count() - 1


def test_a_row_shows_the_first_segment_of_a_session_that_outgrows_it(spark, prepared, monkeypatch):
    cut = units.session_units(prepared, limit=3)
    first = {r["unit_id"]: r["_text"] for r in cut.heads.collect()}
    whole = {r["unit_id"]: r["_text"] for r in cut.per_unit.collect()}
    assert whole.keys() == first.keys() and all(len(whole[u]) > len(first[u]) for u in first)
    monkeypatch.setattr(units, "WHOLE_BYTES", 0)
    assert {r["unit_id"]: r["_text"] for r in cut.per_unit.collect()} == first
    lexicon = lexical.fit_lexicon(cut, 500)
    assert lexical.tfidf_vectors(cut, lexicon).count() == len(first)


def test_the_first_known_label_of_a_session(spark):
    rows = [(1, "a", "k", None), (2, "a", "k", 1), (3, "a", "k", 0), (4, "b", "k", None)]
    frame = spark.createDataFrame(rows, "row_id bigint, _session string, _template string, _target int").withColumn("_text", F.lit("x"))
    for limit in (100, 1):
        found = {r["unit_id"]: (r["first_label"], r["_target"]) for r in units.session_units(frame, limit).heads.collect()}
        assert found == {"a": (1, None), "b": (None, None)}
