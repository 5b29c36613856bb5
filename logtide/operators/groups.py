"""Connected groups: rows that share a scenario or session id, directly or through a chain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.functions import text as T
from logtide.operators.prepare import find_column, quoted
from logtide.operators.skew import HOT_ROWS, salted_lookup, sized_lookup, with_row_position
from logtide.runtime import stored

# Edges that a task contracts at a time: 32 MB of numbers.
CONTRACTED_ROWS = 2_000_000

# Node prefixes keep scenario and session ids apart and make a scenario the smallest node.
SCENARIO, SESSION, ROW = "A:", "B:", "R:"


def _node(frame: DataFrame, field: str, prefix: str) -> Column:
    name = find_column(frame.columns, (field,))
    if name is None:
        return F.lit(None).cast("string")
    value = T.as_string(quoted(name))
    return F.when(value != "", F.concat(F.lit(prefix), value))


def link_edges(frame: DataFrame) -> DataFrame:
    """Distinct (hi, lo) pairs of session and scenario nodes; a pair repeated in many rows shrinks to one."""
    pairs = frame.select(_node(frame, "session_id", SESSION).alias("hi"), _node(frame, "scenario_id", SCENARIO).alias("lo"))
    return pairs.where("hi is not null and lo is not null").distinct()


def component_roots(edges: DataFrame, asked: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, root) for every `lo` of `edges` that is not itself a root and every `hi` among `asked`; the root is the
    smallest node reachable. No node is both a `hi` and a `lo`, and every `lo` is smaller than any `hi`.

    Each `hi` first goes into its smallest neighbour, which links its other neighbours: a `hi` of one edge leaves none.
    What is left gets dense numbers in its own order, so that rounds shuffle pairs of longs only.
    """
    edges = stored(edges.select("hi", "lo"), "edges")
    least = stored(edges.groupBy("hi").agg(F.min("lo").alias("m")), "least")
    apart = _looked_up(edges, least, "hi", edges.count() > hot_rows).where("lo <> m")
    edges = stored(apart.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct(), "links")
    nodes = edges.select(F.col("hi").alias("node")).unionByName(edges.select(F.col("lo").alias("node"))).distinct()
    names = stored(with_row_position(nodes, [F.col("node")], "id"), "nodes")
    for end in ("hi", "lo"):
        named = names.select(F.col("node").alias(end), F.col("id").alias("_id"))
        # Adaptive execution splits what a hot node brings together.
        edges = edges.join(named, end).drop(end).withColumnRenamed("_id", end)
    roots = number_roots(edges, hot_rows)
    found = roots.join(names.select(F.col("id").alias("lo"), F.col("node").alias("root")), "lo")
    found = stored(found.join(names.select(F.col("id").alias("hi"), "node"), "hi").select("node", "root"), "roots")
    wanted = sized_lookup(least, asked.select(F.col("node").alias("hi")), "hi", "inner")
    reached = wanted.join(found.withColumnRenamed("node", "m"), "m", "left")
    return found.unionByName(stored(reached.select(F.col("hi").alias("node"), F.coalesce("root", "m").alias("root")), "roots"))


def number_roots(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(hi, lo) with one row per node that is no root, lo its root, from pairs of longs.

    Each round first replaces the edges of a task, `CONTRACTED_ROWS` of them, by stars around the smallest nodes they
    reach; what fits one task is then done. Otherwise every node goes into the first of itself and its neighbours by a
    hash of the round (Bögeholz et al., 2020), which leaves at most three quarters of the nodes on average, and the
    edges are those between what is left: all rounds together shuffle a multiple of the first. The rounds' choices are
    then followed backwards, and each component takes its smallest node.
    """
    current = stored(edges.where("hi <> lo").select(F.col("hi").cast("bigint"), F.col("lo").cast("bigint")), "numbered")
    rounds: list[DataFrame] = []
    while True:
        tasks = -(-current.count() // CONTRACTED_ROWS)
        current = contracted(current.coalesce(max(1, tasks)))
        if tasks <= 1:
            # All edges met in one task's share: its stars are the result.
            break
        salted = current.count() > hot_rows
        rounds.append(stored(_chosen(current, len(rounds)), "chosen"))
        for end in ("hi", "lo"):
            to = rounds[-1].select(F.col("node").alias(end), F.col("to").alias("_to"))
            current = _looked_up(current, to, end, salted).drop(end).withColumnRenamed("_to", end)
        ends = current.where("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo"))
        current = stored(ends.distinct(), "round")
    if not rounds:
        return current
    found = current.select(F.col("hi").alias("node"), F.col("lo").alias("to"))
    for chosen in reversed(rounds):
        above = found.select(F.col("node").alias("to"), F.col("to").alias("_above"))
        salted = chosen.count() > hot_rows
        found = stored(_looked_up(chosen, above, "to", salted, "left").select("node", F.coalesce("_above", "to").alias("to")), "found")
    least = found.groupBy("to").agg(F.min("node").alias("lo"))
    smallest = _looked_up(found, least, "to", found.count() > hot_rows)
    return stored(smallest.where("node <> lo").select(F.col("node").alias("hi"), "lo"), "smallest")


def stars(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable by these edges) of every node that reaches a smaller one."""
    nodes, flat = np.unique(np.concatenate([hi, lo]), return_inverse=True)
    left, right = flat[: len(hi)], flat[len(hi) :]
    parent = np.arange(len(nodes))
    while True:
        a, b = parent[left], parent[right]
        apart = a != b
        if not apart.any():
            below = parent != np.arange(len(nodes))
            return nodes[below], nodes[parent[below]]
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges with the same components, for each lot of rows at most one per node; nothing is shuffled."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def made() -> pa.RecordBatch:
            hi, lo = stars(*(np.concatenate([pair[k] for pair in held]) for k in range(2)))
            return pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], names=["hi", "lo"])

        for batch in batches:
            held.append((batch.column("hi").to_numpy(), batch.column("lo").to_numpy()))
            size += batch.num_rows
            if size >= CONTRACTED_ROWS:
                yield made()
                held, size = [], 0
        if size:
            yield made()

    return stored(edges.mapInArrow(contract, "hi bigint, lo bigint"), "contracted")


def _looked_up(rows: DataFrame, lookup: DataFrame, key: str, salted: bool, how: str = "inner") -> DataFrame:
    return salted_lookup(rows, lookup, key, how) if salted else rows.join(lookup, key, how)


def _chosen(edges: DataFrame, seed: int) -> DataFrame:
    """(node, to): of each node and its neighbours the first by a hash of number and round."""

    def placed(number: str) -> Column:
        return F.struct(F.xxhash64(number, F.lit(seed)).alias("place"), F.col(number).alias("number"))

    both = edges.select(F.col("lo").alias("node"), F.col("hi").alias("other")).unionByName(
        edges.select(F.col("hi").alias("node"), F.col("lo").alias("other"))
    )
    first = both.groupBy("node").agg(F.min(placed("other")).alias("first"))
    return first.select("node", F.least("first", placed("node"))["number"].alias("to"))


def connected_groups(frame: DataFrame) -> DataFrame:
    """Adds `group_id`; rows with neither id are groups of their own and never enter the loop."""
    scenario, session = _node(frame, "scenario_id", SCENARIO), _node(frame, "session_id", SESSION)
    node = F.coalesce(scenario, session)
    # Sessions are looked up by rows without a scenario only.
    roots = component_roots(link_edges(frame), frame.where(scenario.isNull()).select(session.alias("node")).where("node is not null").distinct())
    tagged = frame.withColumn("node", node)
    found = sized_lookup(tagged, roots, "node")
    own = F.concat(F.lit(ROW), F.col("row_id").cast("string"))
    return found.withColumn("group_id", F.coalesce("root", "node", own)).drop("node", "root")


def group_classes(grouped: DataFrame, target: str = "_target") -> DataFrame:
    """Normal and abnormal rows per group, with the purity class."""
    counts = grouped.groupBy("group_id").agg(
        F.coalesce(F.sum(F.when(F.col(target) == 0, F.lit(1).cast("bigint"))), F.lit(0)).alias("normal"),
        F.coalesce(F.sum(F.when(F.col(target) == 1, F.lit(1).cast("bigint"))), F.lit(0)).alias("abnormal"),
    )
    purity = (
        F.when((F.col("normal") > 0) & (F.col("abnormal") > 0), "mixed")
        .when(F.col("normal") > 0, "pure_normal")
        .otherwise("pure_abnormal")
    )
    return counts.withColumn("purity", purity)
