"""Embedding near-duplicates: a neighbour graph by NN-descent, its threshold edges, and exact link counts.

Equal vectors form a class. A forest of random hyperplane cells gives each class its first neighbours. A cell of more
than `BLOCK` rows is split by further hyperplanes through its own mean; what still stays together, or meets in one
list, is compared in full, block by block. Rounds of
NN-descent then join neighbours of neighbours: around each class, those neighbours that are near enough to lead to a
link are compared with each other, and every list keeps its best. A list whose every entry reaches the threshold is
saturated and may hide links; so every block that is compared also gives a spanning forest of all its links, which
joins what the lists leave out. Inside a component all pairs are compared in blocks and only counted. Recall is audited against all vectors, as the share of sampled classes with
all their links found, and again of classes with few links alone, which large groups cannot cover up. Rounds go on with
new cells until one joins no components and both reach `RECALL`; a figure not met after `ROUNDS` rounds is reported by a warning.

A cosine is confirmed in double precision before it counts. Vectors that are null, empty, zero or hold null or
non-finite components link with nothing, nor do vectors of different length. Rows without an id have no links and no
component, and are kept. Ties: the smallest id stands for a component. Rows that repeat an id stand for one vector,
the smallest of theirs. Copies are never expanded into pairs: a class carries its number of ids.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.llm.common import batch_rows, components, sample_by_hash, stored
from logtide.llm.groups import Arrays, map_groups

THRESHOLD = 0.95
# Neighbours kept of each class, fewest trees of a round, mean cell size, rows compared at once.
LIST, TREES, CELL, BLOCK = 10, 6, 64, 512
# Two vectors linked through a third at THRESHOLD have a cosine of at least 2 * THRESHOLD^2 - 1 = 0.805 with each
# other's links, so neighbours below this lead to no further link of such a chain.
JOIN_FLOOR = 0.8
# Times that oversized cells are split before their blocks are compared with each other.
SPLITS = 4
# Rounds at most, classes audited of all and of those with few links found, share to be reached.
ROUNDS, AUDIT, AUDIT_FEW, RECALL = 30, 512, 2_048, 0.99
# Cosines are searched with this slack and then confirmed.
_SLACK = 1e-6


def _unit(vector) -> np.ndarray | None:
    if vector is None or not len(vector):
        return None
    values = np.array(vector, dtype=np.float64)
    largest = np.abs(values).max()
    if not np.isfinite(values).all() or largest == 0:
        return None
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    values /= largest
    return values / np.sqrt(values @ values)


def unit(vector: Column) -> Column:
    """The vector at length 1 in doubles; null if it links with nothing."""

    @F.pandas_udf("array<double>")
    def scaled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_unit(row) for row in batch], dtype=object)

    return scaled(vector.cast("array<double>"))


def _matrix(vectors: np.ndarray) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


def _pairs_of(points: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosines confirmed one by one, the same whatever block they were found in."""
    return np.einsum("ij,ij->i", points[left], points[right])


_EDGES = "a bigint, b bigint, cosine double, tie boolean"


def _spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a symmetric matrix of links: the fewest that keep its components."""
    unseen = linked.any(axis=1)
    left, right = [], []
    for root in np.flatnonzero(unseen):
        if not unseen[root]:
            continue
        unseen[root] = False
        waiting = [root]
        while waiting:
            row = waiting.pop()
            new = np.flatnonzero(linked[row] & unseen)
            unseen[new] = False
            left.append(np.full(len(new), row))
            right.append(new)
            waiting.extend(new)
    none = [np.empty(0, dtype=np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def _lists(group: Arrays) -> Iterator[tuple]:
    """The best `LIST` neighbours of each row of side 0, on side 1 or among themselves without any, and ties.

    Ties are a spanning forest of all links compared.
    """
    reps, side, points = group["rep"], group["side"], _matrix(group["vector"])
    own, paired = np.flatnonzero(side == 0), bool(side.any())
    other = np.flatnonzero(side == 1) if paired else own
    if len(own) + paired < 2:
        return
    cosines = points[own] @ points[other].T
    if not paired:
        np.fill_diagonal(cosines, -2.0)
    k = min(LIST, len(other) - (not paired))
    near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    i, j = np.nonzero(np.take_along_axis(cosines, near, axis=1) >= JOIN_FLOOR)
    found = cosines >= THRESHOLD + _SLACK
    close_i, close_j = np.nonzero((cosines >= THRESHOLD - _SLACK) & ~found)
    found[close_i, close_j] = _pairs_of(points, own[close_i], other[close_j]) >= THRESHOLD
    linked = np.zeros((len(reps), len(reps)), dtype=bool)
    linked[np.ix_(own, other)] = found
    tied, ahead = _spanning(linked | linked.T)
    left, right = np.concatenate([own[i], tied]), np.concatenate([other[near[i, j]], ahead])
    yield reps[left], reps[right], _pairs_of(points, left, right), np.arange(len(left)) >= len(i)


def _in_blocks(rows: DataFrame, group: str, classes: DataFrame, *columns: str) -> DataFrame:
    """(cell, side, rep, columns): every pair of blocks of `BLOCK` of the (group, rep) rows, the rows of the first on side 0."""
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / BLOCK).cast("bigint").alias("parts"))
    placed = rows.join(sizes, group).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("parts")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    ways = F.array(
        F.struct(F.xxhash64(group, "mine", "other").alias("cell"), F.lit(0).alias("side")),
        F.when(F.col("other") != F.col("mine"), F.struct(F.xxhash64(group, "other", "mine").alias("cell"), F.lit(1).alias("side"))),
    )
    both = placed.select("rep", F.explode(F.filter(ways, lambda way: way.isNotNull())).alias("way")).select("rep", "way.cell", "way.side")
    return both.join(classes.select("rep", *columns), "rep")


def _best_lists(edges: DataFrame) -> DataFrame:
    """The best `LIST` entries of every list as `listed`, and all ties."""
    order = Window.partitionBy("a").orderBy(F.desc("listed"), F.desc("cosine"), "b")
    once = edges.groupBy("a", "b").agg(F.max("cosine").alias("cosine"), F.bool_or("tie").alias("tie"), F.bool_or("listed").alias("listed"))
    placed = once.withColumn("n", F.row_number().over(order)).withColumn("listed", F.col("listed") & (F.col("n") <= LIST))
    return placed.where(F.col("listed") | F.col("tie")).drop("n")


def cell_bits(count: int) -> int:
    return max(1, int(np.ceil(np.log2(max(2, count) / CELL))))


def tree_count(bits: int) -> int:
    """Trees in which a pair at `THRESHOLD` shares a cell of so many hyperplanes at least once with a chance of `RECALL`."""
    shared = (1 - np.arccos(THRESHOLD) / np.pi) ** bits
    return max(TREES, int(np.ceil(np.log(1 - RECALL) / np.log(1 - shared))))


def _codes(points: np.ndarray, bits: int, *seed: int) -> np.ndarray:
    planes = np.random.default_rng(seed).standard_normal((points.shape[1], bits))
    return (points @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64))


def _split(cells: DataFrame, classes: DataFrame, round_: int, depth: int) -> DataFrame:
    """Cells of more than `BLOCK` rows split by hyperplanes through their means; the others stay."""

    @F.pandas_udf("bigint")
    def codes(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for vectors, means, trees, bits in batches:
            out = np.zeros(len(vectors), dtype=np.int64)
            asked = pd.DataFrame({"n": vectors.map(len), "tree": trees, "bits": bits}).reset_index(drop=True)
            for (n, tree, wanted), part in asked.groupby(["n", "tree", "bits"]):
                at = part.index.to_numpy()
                points = _matrix(vectors.to_numpy()[at]) - _matrix(means.to_numpy()[at])
                out[at] = _codes(points, int(wanted), int(n), round_, int(tree), depth)
            yield pd.Series(out)

    sizes = stored(cells.groupBy("cell").agg(F.count("*").alias("rows")).where(F.col("rows") > BLOCK), "sizes")
    if sizes.isEmpty():
        return cells
    bits = F.greatest(F.lit(1), F.ceil(F.log2(F.col("rows") / CELL))).cast("int")
    hot = stored(cells.join(sizes.select("cell", bits.alias("bits")), "cell").join(classes.select("rep", "vector"), "rep"), "hot")
    means = hot.groupBy("cell").agg(vector_to_array(Summarizer.mean(array_to_vector("vector"))).alias("mean"))
    parts = hot.join(means, "cell").select("rep", "tree", F.xxhash64("cell", codes("vector", "mean", "tree", "bits")).alias("cell"))
    return stored(cells.join(sizes, "cell", "left_anti").select("rep", "tree", "cell").union(parts), "cells")


def forest(classes: DataFrame, count: int, round_: int) -> DataFrame:
    """First neighbours: classes that share a cell of random hyperplanes."""
    bits = cell_bits(count)
    trees = tree_count(bits)

    @F.pandas_udf("array<bigint>")
    def codes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list = [None] * len(batch)
            lengths = batch.map(len).to_numpy()
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                points = _matrix(batch.to_numpy()[at])
                found = [_codes(points, bits, int(n), round_, tree) for tree in range(trees)]
                for i, row in zip(at, np.stack(found, axis=1).tolist(), strict=True):
                    out[i] = row
            yield pd.Series(out)

    spread = classes.select("rep", F.size("vector").alias("n"), F.posexplode(codes("vector")).alias("tree", "code"))
    cells = stored(spread.select("rep", "tree", F.xxhash64(F.lit(round_), "tree", "code", "n").alias("cell")), "cells")
    for depth in range(SPLITS):
        split = _split(cells, classes, round_, depth)
        if split is cells:
            break
        cells = split
    return map_groups(_in_blocks(cells.select("cell", "rep").withColumnRenamed("cell", "group"), "group", classes, "vector"), "cell", _lists, _EDGES)


def neighbours_of_neighbours(classes: DataFrame, lists: DataFrame) -> DataFrame:
    """Compares the near neighbours of each class, listed from either end, with each other."""
    near = lists.where(F.col("cosine") >= JOIN_FLOOR).select("a", "b")
    both = near.union(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return map_groups(_in_blocks(both.select("a", F.col("b").alias("rep")), "a", classes, "vector"), "cell", _lists, _EDGES)


_COUNTS = "rep bigint, n bigint"


def _counted(group: Arrays) -> Iterator[tuple]:
    """Links of the rows of side 0 with those of side 1, or among themselves without any, counted with the number of copies."""
    reps, side, points = group["rep"], group["side"], _matrix(group["vector"])
    own = np.flatnonzero(side == 0)
    other = np.flatnonzero(side == 1) if side.any() else own
    totals = np.zeros(len(own), dtype=np.int64)
    for start in range(0, len(own), 256):
        rows = own[start : start + 256]
        i, j = np.nonzero(points[rows] @ points[other].T >= THRESHOLD - _SLACK)
        j = other[j]
        linked = (reps[rows[i]] != reps[j]) & (_pairs_of(points, rows[i], j) >= THRESHOLD)
        totals[start : start + 256] = np.bincount(i[linked], weights=group["copies"][j[linked]], minlength=len(rows))
    yield reps[own], totals


def counted_links(classes: DataFrame, found: DataFrame) -> DataFrame:
    """(rep, n): vectors linked with each class in its component, by all pairs of the component in blocks."""
    named = found.withColumnRenamed("node", "rep")
    rows = _in_blocks(named, "component", classes, "vector", "copies")
    return map_groups(rows, "cell", _counted, _COUNTS).groupBy("rep").agg(F.sum("n").alias("n"))


def audit(classes: DataFrame, counts: DataFrame, sample: int = AUDIT, few: int = AUDIT_FEW) -> float:
    """Share of sampled linked classes with all the links that brute force finds, or that of classes with few links if lower.

    The classes with few links, `LIST` at most, are drawn from all with so few links found, none included, as a class
    never has more links found than true ones.
    """
    found = classes.select("rep").join(counts, "rep", "left").select("rep", F.coalesce("n", F.lit(0)).alias("n"))
    of_all = {row["rep"]: row["n"] for row in sample_by_hash(found, "rep", sample).collect()}
    of_few = {row["rep"]: row["n"] for row in sample_by_hash(found.where(F.col("n") <= LIST), "rep", few).collect()}
    known = of_all | of_few
    if not known:
        return 1.0
    asked = classes.sparkSession.createDataFrame([(rep,) for rep in known], "rep bigint")
    by_length: dict[int, tuple[list, list]] = {}
    for row in classes.select("rep", "vector").join(F.broadcast(asked), "rep").toLocalIterator():
        ids, points = by_length.setdefault(len(row["vector"]), ([], []))
        ids.append(row["rep"])
        points.append(np.array(row["vector"]))
    shared = classes.sparkSession.sparkContext.broadcast({n: (np.array(ids), np.array(points)) for n, (ids, points) in by_length.items()})

    def brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = {n: np.zeros(len(ids), dtype=np.int64) for n, (ids, _) in shared.value.items()}
        for batch in batches:
            lengths = batch["vector"].map(len).to_numpy()
            for n in np.unique(lengths):
                if n in shared.value:
                    ids, points = shared.value[n]
                    reps, copies = (batch[c].to_numpy()[lengths == n] for c in ("rep", "copies"))
                    others = _matrix(batch["vector"].to_numpy()[lengths == n])
                    i, j = np.nonzero(points @ others.T >= THRESHOLD - _SLACK)
                    linked = (ids[i] != reps[j]) & (np.einsum("ij,ij->i", points[i], others[j]) >= THRESHOLD)
                    totals[n] += np.bincount(i[linked], weights=copies[j[linked]], minlength=len(ids)).astype(np.int64)
        for n, (ids, _) in shared.value.items():
            yield pd.DataFrame({"rep": ids, "n": totals[n]})

    true = classes.select("rep", "vector", "copies").mapInPandas(brute, _COUNTS).groupBy("rep").agg(F.sum("n").alias("true"))
    true = {row["rep"]: row["true"] for row in true.collect()}
    whole = [true[rep] == n for rep, n in of_all.items() if true[rep]]
    whole_few = [true[rep] == n for rep, n in of_few.items() if 0 < true[rep] <= LIST]
    return min((float(np.mean(part)) for part in (whole, whole_few) if part), default=1.0)


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of the embeddings."""
    batch_rows(embeddings.sparkSession, 1_000)
    units = embeddings.select("vec_id", unit(F.col("embedding")).alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    known = stored(units.groupBy("vec_id").agg(F.min("vector").alias("vector")), "units")
    classes = stored(known.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    count = classes.count()
    lists = found = counts = None
    joined, recall = 0, 0.0
    for round_ in range(ROUNDS):
        first = forest(classes, count, round_).withColumn("listed", ~F.col("tie"))
        edges = stored(_best_lists(first if lists is None else first.union(lists)), "lists")
        more = neighbours_of_neighbours(classes, edges.where("listed")).withColumn("listed", ~F.col("tie"))
        edges = stored(_best_lists(edges.union(more)), "lists")
        # Ties live on in the components, so only lists are carried on.
        lists = edges.where("listed").withColumn("tie", F.lit(False))
        links = edges.where(F.col("cosine") >= THRESHOLD).select("a", "b")
        found = stored(components(links if found is None else links.union(found.select("node", "component"))), "found")
        before, joined = joined, found.where("node <> component").count()
        if joined > before and round_ < ROUNDS - 1:
            continue
        counts = stored(counted_links(classes, found), "counts")
        recall = audit(classes, counts)
        if recall >= RECALL and joined == before:
            break
    else:
        said = f"recall {recall:.4f} of {RECALL}, {joined - before} components joined by the last round"
        warnings.warn(f"Near-duplicate links not settled in {ROUNDS} rounds: {said}.", RuntimeWarning, stacklevel=2)
    linked = counts.where("n > 0").select("rep", "n")
    named = classes.join(linked, "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select(
        "vector",
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("rep")).alias("component_id"),
    )
    of_id = known.join(named, "vector").select("vec_id", "n_links", "component_id")
    placed = embeddings.where("vec_id IS NOT NULL").select("vec_id").join(of_id, "vec_id", "left")
    rest = embeddings.where("vec_id IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = placed.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).union(rest)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
