"""Event-template sequences: key ids, masking and the masked-event surprise of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.operators.skew import (
    GROUP_ROWS,
    hash_digit,
    hash_order,
    running_totals,
    sized_lookup,
    with_row_position,
)
from logtide.operators.units import Units

# --- fixed values ---------------------------------------------------------------------------
PAD_ID, DIST_ID, MASK_ID, UNK_ID = 0, 1, 2, 3
SPECIAL_KEYS = (("[PAD]", PAD_ID), ("[DIST]", DIST_ID), ("[MASK]", MASK_ID), ("[UNK]", UNK_ID))
MASK_SHARE = 0.3
# -------------------------------------------------------------------------------------------

_START, _END = "[DIST]", "[PAD]"


def key_vocabulary(train: Units) -> DataFrame:
    """(key, id): train keys in sorted order after the special ids.

    Numbered by a range sort and per-partition offsets, so a very large vocabulary stays distributed.
    """
    keys = train.frame.select(F.explode(F.array_distinct("log_keys")).alias("key")).distinct()
    special = [name for name, _ in SPECIAL_KEYS]
    placed = with_row_position(keys.where(~F.col("key").isin(special)), [F.col("key")], "_n")
    fixed = keys.sparkSession.createDataFrame(list(SPECIAL_KEYS), "key string, id bigint")
    return fixed.unionByName(placed.select("key", (F.col("_n") + len(SPECIAL_KEYS) - 1).alias("id")))


def longest_session(train: Units) -> int:
    return int(train.frame.agg(F.max("event_count")).first()[0] or 0)


def session_events(units: Units) -> DataFrame:
    """(unit_id, position, key, previous, following, event_count), one row per event, positions from 1.

    Neighbours come from the segment's own array; only its two ends look across a border.
    """
    frame = units.frame
    size = F.size("log_keys")
    before = F.concat(F.array(F.coalesce("lead_key", F.lit(_START))), F.slice("log_keys", F.lit(1), size - 1))
    after = F.concat(F.slice("log_keys", F.lit(2), size - 1), F.array(F.coalesce("trail_key", F.lit(_END))))
    zipped = F.arrays_zip(F.col("log_keys").alias("k"), before.alias("p"), after.alias("n"))
    rows = frame.select(
        "unit_id", "offset", "event_count", "_target", "_split", F.posexplode(zipped).alias("_at", "_e")
    )
    return rows.select(
        "unit_id",
        (F.col("offset") + F.col("_at") + 1).alias("position"),
        F.col("_e.k").alias("key"),
        F.col("_e.p").alias("previous"),
        F.col("_e.n").alias("following"),
        "event_count",
        "_target",
        "_split",
    )


def key_sequences(units: Units, vocabulary: DataFrame, max_events: int, limit: int = GROUP_ROWS) -> DataFrame:
    """(unit_id, segment, ids): keys as ids, unknown keys as UNK, cut after `max_events` events."""
    events = session_events(units).where(F.col("position") <= max_events).select("unit_id", "position", "key")
    mapped = sized_lookup(events, vocabulary, "key")
    segment = F.floor((F.col("position") - 1) / limit).cast("int").alias("segment")
    packed = mapped.groupBy("unit_id", segment).agg(
        F.array_sort(F.collect_list(F.struct("position", F.coalesce("id", F.lit(UNK_ID)).alias("id")))).alias("_s")
    )
    return packed.select("unit_id", "segment", F.col("_s.id").cast("array<int>").alias("ids"))


def mask_count(events: Column, share: float = MASK_SHARE) -> Column:
    """Half-even rounding of the share, at least one."""
    return F.greatest(F.lit(1), F.bround(events * F.lit(share)).cast("bigint"))


def masked_events(events: DataFrame, seed: int = 42, limit: int = GROUP_ROWS) -> DataFrame:
    """Adds `masked`: the first `mask_count` events of each unit in seeded hash order."""
    place = F.concat_ws(":", F.col("unit_id"), F.col("position").cast("string"))
    keyed = events.withColumn("_order", hash_order(place, seed))
    window = Window.partitionBy("unit_id").orderBy("_order", "position")
    small = keyed.where(F.col("event_count") <= limit).withColumn("_rank", F.row_number().over(window).cast("bigint"))
    large = keyed.where(F.col("event_count") > limit)
    large = large.withColumn("_digit", hash_digit(F.col("_order"))).withColumn("_one", F.lit(1).cast("bigint"))
    ranked = running_totals(large, ["unit_id"], ["_digit"], [F.col("_order"), F.col("position")], ["_one"])
    ranked = ranked.withColumnRenamed("cum__one", "_rank").drop("total__one", "_one", "_digit")
    both = small.unionByName(ranked)
    return both.withColumn("masked", F.col("_rank") <= mask_count(F.col("event_count"))).drop("_rank", "_order")


def _context(*columns: str) -> Column:
    return F.concat_ws("\u0001", *columns)


def context_model(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Key counts per (previous, following) context and context totals, from normal train sessions."""
    counts = events.groupBy(_context("previous", "following", "key").alias("_event")).agg(
        F.count(F.lit(1)).alias("_seen")
    )
    totals = events.groupBy(_context("previous", "following").alias("_ctx")).agg(F.count(F.lit(1)).alias("_total"))
    return counts, totals


def session_surprise(events: DataFrame, model: tuple[DataFrame, DataFrame], keys: int) -> DataFrame:
    """(unit_id, surprise): mean -ln p of the masked events, with add-one smoothing over `keys` keys."""
    counts, totals = model
    wanted = events.where("masked").select(
        "unit_id",
        _context("previous", "following", "key").alias("_event"),
        _context("previous", "following").alias("_ctx"),
    )
    scored = sized_lookup(sized_lookup(wanted, counts, "_event"), totals, "_ctx")
    chance = (F.coalesce("_seen", F.lit(0)) + 1.0) / (F.coalesce("_total", F.lit(0)) + F.lit(float(keys)))
    return scored.groupBy("unit_id").agg(F.avg(-F.log(chance)).alias("surprise"))
