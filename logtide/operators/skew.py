"""Joins, running totals and positions that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.runtime import BROADCAST_ROWS, pinned, rows_at_most

# A key is hot when it holds more than this many rows and more than 1/HOT_SHARES of the table,
# so there are fewer than HOT_SHARES hot keys whatever the table size.
HOT_ROWS = 1_000_000
HOT_SHARES = 1_000
# Largest group handled by one window or one collected list.
GROUP_ROWS = 16_384


def key_sizes(facts: DataFrame, key: str) -> DataFrame:
    return facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))


def hot_keys(sizes: DataFrame, key: str, rows: int = HOT_ROWS, shares: int = HOT_SHARES) -> DataFrame:
    """(key, _salts) for keys above the hot limit; fewer than `shares` rows by construction."""
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_total")).scalar()
    piece = F.greatest(F.lit(rows).cast("double"), total / F.lit(float(shares)))
    return sizes.where(F.col("_n") > piece).select(key, F.ceil(F.col("_n") / piece).cast("int").alias("_salts"))


def salted_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    how: str = "left",
    rows: int = HOT_ROWS,
    shares: int = HOT_SHARES,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Join `facts` to a lookup that has one row per key, cutting every hot key into salted pieces.

    Only the list of hot keys is broadcast; its size has a fixed bound. Lookup rows of hot keys
    are repeated once per piece, all other rows take part in a plain shuffle join. `sizes` is
    (key, _n) when the caller already counted the keys.
    """
    hot = hot_keys(key_sizes(facts, key) if sizes is None else sizes, key, rows, shares)
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in facts.columns if _hashable(facts, c)]), F.col("_salts"))
    left = facts.join(F.broadcast(hot), key, "left").withColumn("_salt", F.coalesce(spread, F.lit(0)).cast("int"))
    right = (
        lookup.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )
    return left.drop("_salts").join(right, [key, "_salt"], how).drop("_salt")


def _hashable(frame: DataFrame, column: str) -> bool:
    return frame.schema[column].dataType.typeName() not in ("map", "variant", "udt")


def sized_lookup(
    facts: DataFrame, lookup: DataFrame, key: str, how: str = "left", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Broadcast the lookup if its measured size allows, otherwise use the salted shuffle join."""
    if rows_at_most(lookup, max_rows):
        return facts.join(F.broadcast(lookup), key, how)
    return salted_lookup(facts, lookup, key, how)


def split_by_size(
    frame: DataFrame,
    key: str,
    limit: int = GROUP_ROWS,
    max_rows: int = BROADCAST_ROWS,
    size: Column | None = None,
    size_limit: int = 0,
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups within `limit` rows and `size_limit` summed over `size`, rows of larger groups or None).

    Group sizes come from one aggregation over the key column. The list of large groups is
    broadcast only when it was counted to be small.
    """
    total = F.lit(0) if size is None else F.sum(size)
    sizes = frame.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), total.alias("_size"))
    large = sizes.where((F.col("_n") > limit) | (F.col("_size") > size_limit)).select(key)
    found = large.limit(max_rows + 1).count()
    if found == 0:
        return frame, None
    if found <= max_rows:
        large = F.broadcast(large)
        return frame.join(large, key, "left_anti"), frame.join(large, key, "left_semi")
    flagged = salted_lookup(frame, large.withColumn("_large", F.lit(True)), key)
    is_large = F.col("_large").isNotNull()
    return flagged.where(~is_large).drop("_large"), flagged.where(is_large).drop("_large")


def score_digits(score: Column) -> list[Column]:
    """Two order-keeping digits of a non-negative double: binary exponent, then mantissa steps.

    Scores crowded near zero still spread out, since each power of two has its own cells.
    """
    exponent = F.when(score > 0, F.floor(F.log2(score))).otherwise(F.lit(-1100))
    scaled = F.when(score > 0, score / F.pow(F.lit(2.0), F.greatest(exponent, F.lit(-1000)))).otherwise(F.lit(0.0))
    return [exponent.cast("int"), F.floor(scaled * F.lit(65536.0)).cast("bigint")]


def hash_order(value: Column, seed: int | str) -> Column:
    """Seeded pseudo-random order key, the same on every engine that has MD5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), value.cast("string")).cast("binary"))


def hash_digit(key: Column) -> Column:
    """First 16 bits of `hash_order`: 65,536 evenly filled cells."""
    return F.substring(key, 1, 4)


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on equal keys in which a null equals a null."""
    renamed = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    same = [F.col(key).eqNullSafe(F.col(f"_right_{key}")) for key in keys]
    return left.join(renamed, same).drop(*[f"_right_{key}" for key in keys])


def running_totals(
    frame: DataFrame,
    groups: Sequence[str],
    digits: Sequence[str],
    order: Sequence[Column],
    values: Sequence[str],
) -> DataFrame:
    """Adds `cum_<value>`, the inclusive running sum inside the group, and `total_<value>` of the group.

    `digits` name columns that cut a group's order into nested cells, coarse to fine. Sums run
    inside the finest cell; offsets of earlier cells are prefix sums over the much smaller cell
    tables, so no task ever sees a whole group.
    """
    groups, digits, values = list(groups), list(digits), list(values)
    cell = groups + digits
    inside = Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = frame.select("*", *[F.sum(v).over(inside).alias(f"_run_{v}") for v in values])
    totals = frame.groupBy(*cell).agg(*[F.sum(v).alias(v) for v in values])
    offsets = None
    for depth in range(len(digits), 0, -1):
        parent = groups + digits[: depth - 1]
        family = Window.partitionBy(*parent)
        earlier = family.orderBy(digits[depth - 1]).rowsBetween(Window.unboundedPreceding, -1)
        level = totals.select(
            *groups,
            *digits[:depth],
            *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_before{depth}_{v}") for v in values],
            *([F.sum(v).over(family).alias(f"total_{v}") for v in values] if depth == 1 else []),
        )
        offsets = level if offsets is None else _null_safe(offsets, level, groups + digits[:depth])
        if depth > 1:
            totals = totals.groupBy(*parent).agg(*[F.sum(v).alias(v) for v in values])
    depths = range(1, len(digits) + 1)
    before = {v: sum((F.col(f"_before{depth}_{v}") for depth in depths), F.lit(0)) for v in values}
    offsets = offsets.select(
        *cell, *[value.alias(f"_before_{v}") for v, value in before.items()], *[f"total_{v}" for v in values]
    )
    return _null_safe(running, offsets, cell).select(
        *frame.columns,
        *[(F.col(f"_run_{v}") + F.col(f"_before_{v}")).alias(f"cum_{v}") for v in values],
        *[f"total_{v}" for v in values],
    )


def positions(
    frame: DataFrame,
    group: str,
    time: str,
    row_id: str = "row_id",
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """Adds `position`: 1-based order by (time, row_id) inside the group, null times last.

    Groups up to `limit` rows use a plain window. The keys of larger groups are range-sorted into
    even slices and pinned, and positions are running totals over the slices; (group, row_id) must be unique.
    """
    small, large = split_by_size(frame, group, limit)
    order = [F.col(time).isNull(), F.col(time), F.col(row_id)]
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("bigint")
    result = small.withColumn("position", place)
    if large is None:
        return result
    return result.unionByName(large_positions(large, group, time, row_id))


def large_positions(large: DataFrame, group: str, time: str, row_id: str = "row_id") -> DataFrame:
    """`positions` for groups known to be large: ranked on the keys alone, joined back by unique row."""
    order = [F.col(time).isNull(), F.col(time), F.col(row_id)]
    ranked = range_positions(large.select(group, time, row_id), group, order)
    return _null_safe(large, ranked.select(group, row_id, "position"), [group, row_id])


def range_positions(keys: DataFrame, group: str, order: Sequence[Column], slice_rows: int = HOT_ROWS) -> DataFrame:
    """Position inside each group from an even range partitioning of (group, order)."""
    ones = keys.withColumn("_one", F.lit(1).cast("bigint"))
    summed = range_totals(ones, group, order, ["_one"], slice_rows)
    return summed.select(*keys.columns, F.col("cum__one").alias("position"))


def range_totals(rows: DataFrame, group: str, order: Sequence[Column], values: Sequence[str], slice_rows: int = HOT_ROWS) -> DataFrame:
    """`running_totals` inside each group over an even range partitioning of (group, order)."""
    wanted = -(-rows.count() // slice_rows)
    slices = max(wanted, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(slices, F.col(group), *order)
    # Pinned, so that the totals and the rows below see the same slices.
    sliced = pinned(ranged.select("*", F.spark_partition_id().alias("_slice")))
    return running_totals(sliced, [group], ["_slice"], order, values)


def with_row_position(frame: DataFrame, order_by: Sequence[Column] | None = None, name: str = "row_id") -> DataFrame:
    """Dense 1-based position over the whole table.

    Without an order key this is the scan order of a file source. With one, the table is
    range-sorted and pinned first, so that the counting pass and the numbering pass see the
    same partitions. Only one offset row per partition is broadcast.
    """
    if order_by is not None:
        frame = pinned(frame.orderBy(*order_by))
    tagged = frame.withColumn("_place", F.monotonically_increasing_id())
    slice_of = F.shiftright(F.col("_place"), 33)
    counts = tagged.groupBy(slice_of.alias("_slice")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        tagged.withColumn("_slice", slice_of)
        .join(F.broadcast(offsets), "_slice")
        .select(*frame.columns, (F.col("_before") + inner + 1).alias(name))
    )
