"""Queries over the join-shaped operators."""

from pyspark.sql import functions as F

from logtide.functions import text as T
from logtide.operators import audit, scoring
from logtide.operators.skew import salted_lookup, sized_lookup
from logtide.plans import views as V
from logtide.plans.catalog import register


@register(
    f"""WITH {V.SCORES}, times AS (SELECT event_id + 1 AS unit_id, date_trunc('milliseconds', ts) AS t FROM events)
    SELECT ev.model_id, ev.unit_id, ev.predicted, times.t AS unit_time FROM ev LEFT JOIN times ON ev.unit_id = times.unit_id"""
)
def prediction_times(spark, d):
    from logtide.plans.catalog_scoring import evidence_rows

    times = audit.unit_times(V.prepared_logs(spark, d), sessions=False)
    rows = evidence_rows(spark, d).select("model_id", F.col("unit_id").cast("string").alias("unit_id"), "predicted")
    joined = rows.join(times, "unit_id", "left")
    return joined.select("model_id", F.col("unit_id").cast("bigint").alias("unit_id"), "predicted", F.col("unit_time").cast("timestamp_ntz").alias("unit_time"))


@register(
    f"""WITH {V.PREPARED} SELECT e.event_id + 1 AS row_id, coalesce(p._text, e.props) AS cleaned_message, p._target AS known_label
    FROM events e LEFT JOIN (SELECT * FROM prep WHERE _split <> 'test') p ON e.event_id + 1 = p.row_id"""
)
def enrichment_with_fallback(spark, d):
    known = V.prepared_logs(spark, d).where(F.col("_split") != "test").select("row_id", "_text", "_target")
    rows = V.table(spark, d, "events").select((F.col("event_id") + 1).alias("row_id"), "props")
    joined = rows.join(known, "row_id", "left")
    return joined.select("row_id", F.coalesce("_text", "props").alias("cleaned_message"), F.col("_target").alias("known_label"))


_CHAT_TOKENS = f"{V.CHATS}, toks AS (SELECT row_id AS unit_id, unnest(string_split(_text, ' ')) AS token FROM chat WHERE _text <> '')"
_RANKED = """vocab AS (SELECT token, count(*) AS n FROM toks GROUP BY 1), vec AS (
 SELECT token, list_transform(range(0, 4), lambda i: ((length(token) * 7 + n * 3 + i * 11) % 23) / CAST(23 AS DOUBLE)) AS vector, (n % 5) + 1 AS weight FROM vocab WHERE n >= 2)"""
_TOKEN_CTE = f"{_CHAT_TOKENS}, {_RANKED}"


def _chat_tokens(spark, d):
    return V.chat_rows(spark, d).select(
        F.col("row_id").alias("unit_id"), F.explode(T.whitespace_tokens(F.col("_text"))).alias("token")
    )


def _token_vectors(tokens):
    """A vector and a weight per token that occurs at least twice, from integer arithmetic on its count."""
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    parts = [((F.length("token") * 7 + F.col("n") * 3 + i * 11) % 23) / F.lit(23.0) for i in range(4)]
    return counted.select("token", F.array(*parts).alias("vector"), (F.col("n") % 5 + 1).cast("double").alias("weight"))


@register(
    f"""WITH {_TOKEN_CTE} SELECT t.unit_id, count(*) AS known_tokens, round(sum(v.vector[1]), 6) AS first_sum FROM toks t JOIN vec v ON t.token = v.token GROUP BY 1"""
)
def token_vector_lookup(spark, d):
    tokens = _chat_tokens(spark, d)
    found = sized_lookup(tokens, _token_vectors(tokens), "token", "inner")
    return found.groupBy("unit_id").agg(
        F.count(F.lit(1)).alias("known_tokens"), F.round(F.sum(F.col("vector")[0]), 6).alias("first_sum")
    )


@register(
    f"""WITH {_TOKEN_CTE}, light AS (SELECT token, weight FROM vec WHERE weight > 1)
    SELECT t.unit_id, count(*) AS matched, round(sum(v.vector[1] * l.weight), 6) AS weighted_sum
    FROM toks t JOIN vec v ON t.token = v.token JOIN light l ON t.token = l.token GROUP BY 1"""
)
def token_vector_weight_lookup(spark, d):
    tokens = _chat_tokens(spark, d)
    vectors = _token_vectors(tokens)
    weights = vectors.where("weight > 1").select("token", "weight")
    found = sized_lookup(sized_lookup(tokens, vectors.drop("weight"), "token", "inner"), weights, "token", "inner")
    return found.groupBy("unit_id").agg(
        F.count(F.lit(1)).alias("matched"), F.round(F.sum(F.col("vector")[0] * F.col("weight")), 6).alias("weighted_sum")
    )


@register(
    """SELECT e.event_id, coalesce(v.id, 3) AS key_id FROM events e LEFT JOIN
    (SELECT event_type, row_number() OVER (ORDER BY event_type) + 3 AS id FROM (SELECT DISTINCT event_type FROM events WHERE event_type <> 'signup')) v ON e.event_type = v.event_type"""
)
def key_lookup_with_default(spark, d):
    from pyspark.sql import Window

    e = V.table(spark, d, "events").select("event_id", "event_type")
    # Five event types at most reach this window.
    ids = e.where("event_type <> 'signup'").select("event_type").distinct()
    ids = ids.withColumn("id", F.row_number().over(Window.orderBy("event_type")) + 3)
    return sized_lookup(e, ids, "event_type").select("event_id", F.coalesce("id", F.lit(3)).cast("bigint").alias("key_id"))


@register(
    f"""WITH {V.PREPARED} SELECT row_id, _session, _text FROM prep WHERE _session IN (SELECT _session FROM prep WHERE row_id IN (SELECT max(row_id) FROM prep GROUP BY scenario_id))"""
)
def semi_join_sessions(spark, d):
    frame = V.prepared_logs(spark, d)
    newest = frame.groupBy("scenario_id").agg(F.max_by("_session", "row_id").alias("_session")).select("_session")
    return frame.join(newest, "_session", "left_semi").select("row_id", "_session", "_text")


@register(
    """SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)"""
)
def anti_join_unused(spark, d):
    used = V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return V.table(spark, d, "part").select("p_partkey", "p_name").join(used, "p_partkey", "left_anti")


_ALIGNED_SQL = f"""aligned AS (SELECT a.unit_id, a.actual, a._split, a.score AS first, b.score AS second FROM scores a JOIN scores b ON a.unit_id = b.unit_id
 WHERE a.model_id = '{V.MODELS[0]}' AND b.model_id = '{V.MODELS[1]}')"""


def aligned_scores(spark, d):
    s = V.scores(spark, d)
    first, second = (s.where(F.col("model_id") == m) for m in V.MODELS)
    return scoring.fused_scores(first, second)


@register(f"WITH {V.SCORES}, {_ALIGNED_SQL} SELECT unit_id, actual, first, second FROM aligned")
def align_model_scores(spark, d):
    return aligned_scores(spark, d)


@register(
    f"""WITH {V.SCORES}, {_ALIGNED_SQL} SELECT round(g.i * CAST(0.05 AS DOUBLE), 2) AS alpha, count(*) AS "rows",
    round(avg(g.i * CAST(0.05 AS DOUBLE) * first + (1 - g.i * CAST(0.05 AS DOUBLE)) * second), 6) AS mean_score
    FROM aligned, (SELECT unnest(range(0, 21)) AS i) g GROUP BY 1"""
)
def fusion_weight_grid(spark, d):
    grid = scoring.fusion_grid(aligned_scores(spark, d))
    return grid.groupBy(F.round("alpha", 2).alias("alpha")).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg("score"), 6).alias("mean_score")
    )


@register(
    f"""WITH {V.SCORES} SELECT model_id, _split, count(*) AS "rows", count(DISTINCT unit_id) AS units FROM ev GROUP BY ALL"""
)
def evidence_partition_join(spark, d):
    from logtide.plans.catalog_scoring import evidence_rows

    partitions = V.prepared_logs(spark, d).select(F.col("row_id").alias("unit_id"), "_split")
    rows = evidence_rows(spark, d).drop("_split").select("model_id", "unit_id")
    joined = rows.join(partitions, "unit_id")
    per_unit = joined.groupBy("model_id", "_split", "unit_id").agg(F.count(F.lit(1)).alias("n"))
    return per_unit.groupBy("model_id", "_split").agg(
        F.sum("n").cast("bigint").alias("rows"), F.count(F.lit(1)).alias("units")
    )


@register(
    """SELECT l.l_suppkey, s.s_name, count(*) AS "rows", round(sum(l.l_extendedprice), 2) AS price FROM lineitem l
    LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY ALL"""
)
def salted_lookup_join(spark, d):
    """The hot-key join with limits low enough that suppliers are cut into salted pieces."""
    lines = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    names = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    joined = salted_lookup(lines, names, "l_suppkey", "left", rows=50)
    return joined.groupBy("l_suppkey", "s_name").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("l_extendedprice"), 2).alias("price")
    )
