"""Queries over units, sessions, connected groups, splits and allocations."""

from pyspark.sql import functions as F

from logtide.operators import allocate, audit, events, groups, skew, split, units
from logtide.plans import views as V
from logtide.plans.catalog import register


@register(f"WITH {V.PREPARED} SELECT CAST(row_id AS VARCHAR) AS unit_id, session_id, _text, anomaly_type AS known_anomaly_type, _target, _split, CAST(1 AS BIGINT) AS event_count FROM prep")
def log_units(spark, d):
    built = units.log_units(V.prepared_logs(spark, d)).frame
    return built.select("unit_id", "session_id", "_text", "known_anomaly_type", "_target", "_split", "event_count")


@register(
    f"""WITH {V.SESSIONS} SELECT unit_id, _text, array_to_string(log_keys, ',') AS log_keys, array_to_string(row_ids, ',') AS row_ids,
    CAST(row_ids[1] AS VARCHAR) AS row_id, event_count, _target, _split, start_time, known_anomaly_type FROM sess"""
)
def session_units(spark, d):
    built = V.event_sessions(spark, d).frame
    return built.select(
        "unit_id", "_text", F.array_join("log_keys", ",").alias("log_keys"), F.array_join("row_ids", ",").alias("row_ids"),
        "row_id", "event_count", "_target", "_split", F.col("start_time").cast("timestamp_ntz").alias("start_time"), "known_anomaly_type",
    )


@register(
    f"""WITH {V.PREPARED}, placed AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY _timestamp, row_id) - 1 AS p FROM prep)
    SELECT scenario_id AS unit_id, p // 16 AS segment, string_agg(_text, ' [EVENT] ' ORDER BY p) AS _text, array_to_string(list(_template ORDER BY p), ',') AS log_keys,
    (SELECT count(*) FROM prep q WHERE q.scenario_id = placed.scenario_id) AS event_count FROM placed GROUP BY scenario_id, p // 16"""
)
def long_session_segments(spark, d):
    """Whole scenarios as sessions, with a limit low enough that they are held in segments."""
    columns = ("row_id", "scenario_id", "_timestamp", "_text", "log_text", "_template", "anomaly_type", "_target", "_split")
    frame = V.kept_logs(spark, d, *columns).withColumn("_session", F.col("scenario_id"))
    built = units.session_units(frame, limit=16).frame
    return built.select("unit_id", F.col("segment").cast("bigint").alias("segment"), "_text", F.array_join("log_keys", ",").alias("log_keys"), "event_count")


@register(f"WITH {V.CHATS} SELECT unit_id, _text, array_to_string(log_keys, ',') AS log_keys, event_count, _target, _split FROM chats")
def conversation_sessions(spark, d):
    built = V.chat_sessions(spark, d).frame
    return built.select("unit_id", "_text", F.array_join("log_keys", ",").alias("log_keys"), "event_count", "_target", "_split")


@register(
    """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations"""
)
def position_in_session(spark, d):
    c = V.table(spark, d, "conversations").select("conv_id", "turn")
    return skew.positions(c.withColumn("_t", F.timestamp_seconds("turn")), "conv_id", "_t", "turn").select(
        "conv_id", "turn", F.col("position").cast("bigint").alias("position")
    )


@register(
    """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events"""
)
def position_in_long_session(spark, d):
    """All users forced onto the running-total path that hot sessions take."""
    e = V.table(spark, d, "events").select("user_id", "event_id", "ts")
    return skew.positions(e, "user_id", "ts", "event_id", limit=0).select("user_id", "event_id", "position")


@register(
    f"""WITH {V.PREPARED} SELECT CAST(0 AS BIGINT) AS blank_ids,
    (SELECT count(*) FROM (SELECT _session FROM prep GROUP BY 1 HAVING count(DISTINCT _split) > 1)) AS crossing_partitions,
    (SELECT count(*) FROM (SELECT _session FROM prep GROUP BY 1 HAVING count(DISTINCT _target) > 1)) AS crossing_labels"""
)
def session_integrity(spark, d):
    return units.session_violations(V.prepared_logs(spark, d))


@register(f"WITH {V.PREPARED} SELECT _split AS split, count(*) AS units, '0,1' AS classes FROM prep GROUP BY 1")
def partition_classes(spark, d):
    found = units.partition_classes(units.log_units(V.prepared_logs(spark, d)).frame)
    return found.select("split", "units", F.array_join(F.col("classes").cast("array<string>"), ",").alias("classes"))


@register(f"WITH {V.PREPARED} SELECT row_id, _session, _text FROM prep WHERE _session = (SELECT _session FROM prep WHERE row_id = 7)")
def session_of_row(spark, d):
    return units.session_of(V.prepared_logs(spark, d), 7).select("row_id", "_session", "_text")


@register(
    f"""WITH {V.SESSIONS}, known AS (SELECT DISTINCT unnest(log_keys) AS key FROM sess WHERE _split = 'train' AND _target = 0)
    SELECT unit_id, greatest(event_count - 2, 0) AS truncated_events, (SELECT count(*) FROM (SELECT unnest(log_keys) AS k) WHERE k NOT IN (SELECT key FROM known)) AS unseen_events FROM sess"""
)
def truncated_and_unseen_events(spark, d):
    built = V.event_sessions(spark, d)
    normal = built.frame.where((F.col("_split") == "train") & (F.col("_target") == 0))
    return units.truncation(built.frame, 2, normal.select(F.explode("log_keys").alias("key")))


_LINK = """e AS (SELECT l_orderkey AS a, concat(l_partkey, '-', CAST(l_quantity AS INTEGER)) AS b FROM lineitem)"""
_LINK_SQL = f"""WITH RECURSIVE {_LINK}, nodes AS (
 SELECT DISTINCT concat('A:', a) AS id FROM e UNION SELECT DISTINCT concat('B:', b) FROM e), pairs AS (
 SELECT DISTINCT concat('A:', a) AS x, concat('B:', b) AS y FROM e), both_ways AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
 cc(id, comp) USING KEY (id) AS (
 SELECT id, id AS comp FROM nodes
 UNION
 (SELECT w.y, min(c.comp) FROM cc c JOIN both_ways w ON w.x = c.id JOIN recurring.cc old ON old.id = w.y WHERE c.comp < old.comp GROUP BY w.y))
"""


def _linked_lines(spark, d):
    """Line items as rows that share an order, or a part and quantity: chains across many orders."""
    part_quantity = F.concat_ws("-", F.col("l_partkey"), F.col("l_quantity").cast("int"))
    return V.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"),
        F.col("l_orderkey").cast("string").alias("scenario_id"),
        part_quantity.alias("session_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("_target"),
    )


@register(
    _LINK_SQL
    + """SELECT c.comp AS group_id, count(*) AS "rows", count(DISTINCT e.a) AS scenarios FROM e JOIN cc c ON c.id = concat('A:', e.a) GROUP BY 1"""
)
def connected_groups(spark, d):
    grouped = groups.connected_groups(_linked_lines(spark, d))
    per_scenario = grouped.groupBy("group_id", "scenario_id").agg(F.count(F.lit(1)).alias("n"))
    return per_scenario.groupBy("group_id").agg(
        F.sum("n").cast("bigint").alias("rows"), F.count(F.lit(1)).alias("scenarios")
    )


@register(
    f"""WITH {V.PREPARED} SELECT concat('A:', scenario_id) AS group_id, count(*) FILTER (_target = 0) AS normal, count(*) FILTER (_target = 1) AS abnormal,
    CASE WHEN count(DISTINCT _target) = 2 THEN 'mixed' WHEN max(_target) = 0 THEN 'pure_normal' ELSE 'pure_abnormal' END AS purity FROM prep GROUP BY 1"""
)
def group_class_counts(spark, d):
    return groups.group_classes(groups.connected_groups(V.kept_logs(spark, d, "row_id", "scenario_id", "session_id", "_target")))


@register(
    f"""WITH {V.PREPARED} SELECT _split AS split, count(*) AS "rows", count(*) FILTER (_target = 0) AS normal, count(*) FILTER (_target = 1) AS abnormal,
    CAST(0 AS BIGINT) AS unlabelled FROM prep GROUP BY 1"""
)
def provided_split_check(spark, d):
    return split.partition_report(split.apply_split(V.prepared_logs(spark, d)))


@register(
    """SELECT 3 AS partitions, count(*) AS "rows", true AS both_classes_everywhere, CAST(0 AS BIGINT) AS leaking_ids, true AS near_fractions FROM events"""
)
def grouped_split_contract(spark, d):
    """The contract of the custom split: whole groups, both classes everywhere, sizes near 70/15/15."""
    logs = V.kept_logs(spark, d, "row_id", "scenario_id", "session_id", "_target", "_split")
    divided = split.apply_split(logs, "custom")
    report = split.partition_report(divided)
    leaks = audit.group_leakage(divided).agg(F.sum("leaking").alias("leaking_ids")).withColumn("_k", F.lit(1))
    target = F.when(F.col("split") == "train", 0.7).otherwise(0.15)
    share = F.col("rows") / divided.agg(F.count(F.lit(1)).alias("n")).scalar()
    found = report.withColumn("near", F.abs(share - target) < 0.05).agg(
        F.count(F.lit(1)).cast("int").alias("partitions"),
        F.sum("rows").cast("bigint").alias("rows"),
        F.bool_and((F.col("normal") > 0) & (F.col("abnormal") > 0)).alias("both_classes_everywhere"),
        F.bool_and("near").alias("near_fractions"),
    )
    return found.withColumn("_k", F.lit(1)).join(leaks, "_k").drop("_k")


_QUOTA = [("O", "A", 40), ("O", "B", 25), ("O", "C", 3), ("F", "A", 10), ("F", "B", 90), ("P", "C", 5)]


@register(
    "WITH q(o_orderstatus, category, n) AS (VALUES " + ", ".join(f"('{s}', '{c}', {n})" for s, c, n in _QUOTA) + """),
    ranges AS (SELECT o_orderstatus, category, sum(n) OVER (PARTITION BY o_orderstatus ORDER BY category) AS hi, n FROM q),
    r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(concat('42:', o_orderkey)), o_orderkey) AS rank FROM orders)
    SELECT r.o_orderkey, r.o_orderstatus, r.rank, x.category FROM r LEFT JOIN ranges x ON r.o_orderstatus = x.o_orderstatus AND r.rank > x.hi - x.n AND r.rank <= x.hi"""
)
def exact_quota_allocation(spark, d):
    quotas = spark.createDataFrame(_QUOTA, "o_orderstatus string, category string, count bigint")
    orders = V.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return allocate.allocate_quotas(orders, quotas, "o_orderstatus", "o_orderkey")


@register(
    """WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(concat('42:', o_orderkey)), o_orderkey) - 1 AS p,
    count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders), k AS (SELECT *, greatest(1, CAST(round_even(n / CAST(6 AS DOUBLE), 0) AS BIGINT)) AS chunks FROM r),
    s AS (SELECT *, n // chunks AS base, n % chunks AS extra FROM k)
    SELECT o_orderkey, o_orderpriority, p + 1 AS rank, CASE WHEN p < extra * (base + 1) THEN p // (base + 1) ELSE extra + (p - extra * (base + 1)) // base END + 1 AS chunk FROM s"""
)
def fixed_size_groups(spark, d):
    orders = V.table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return allocate.fixed_size_groups(orders, "o_orderpriority", "o_orderkey", bounds=(3, 9))
