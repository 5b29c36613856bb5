"""Exact top-k search by inner product with a dual-tree traversal of cover trees.

Vectors are turned into integers, floor(scale * x). Pivots, chosen far apart from a bounded sample, are the top
level of one tree over queries and data together: each vector goes to its nearest pivot, pivots are cut into blocks
of at most about `BLOCK` rows, and each block builds its cover tree, in which a node's radius covers its members and
its children are far apart and cover them at a smaller one. The queries of a block form a tree of their own over the same points.

A query first takes its best k of its own block. Then a block's queries meet the blocks of a pivot, and in them
their nodes, only where the bound from both centres and covering radii reaches the worst kth score of the query
group: for a query node (q, r) and a data node (p, s) no product exceeds q.p + |q|s + |p|r + rs. What remains is
multiplied out in blocks, and each pair of blocks returns only what beats a query's kth score.

Vectors that are null, empty, or hold null or non-finite components take no part; nor do vectors so long that their
products might not fit a long integer. Vectors meet only vectors of equal length. Ties go to the smaller id. Rows
that repeat id and vector count once; a query never returns its own id. Fewer than k candidates: all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.llm.common import BLOCK_ROWS, batch_rows, sample_by_hash, stored
from logtide.llm.groups import Arrays, map_groups

K, SCALE = 20, 64
# Vectors that the pivots are chosen from, pivots, rows of a block, members of a leaf.
SAMPLE, PIVOTS, BLOCK, LEAF = 2_048, 64, 1_024, 128
# Trees that a task keeps while pairs of blocks go by.
KEPT_TREES = 96
# Most children of a node.
CHILDREN = 12


def codes(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as doubles; null if the vector takes no part."""
    scaled = F.transform(vector, lambda x: F.lit(float(scale)) * x.cast("double"))
    finite = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    length = F.aggregate(scaled, F.lit(0.0), lambda total, x: total + (F.abs(x) + 1) * (F.abs(x) + 1))
    usable = finite & (F.size(vector) > 0)
    return F.when(usable, F.when(length < float(1 << 62), F.transform(scaled, _floor)))


def _floor(x: Column) -> Column:
    """floor of a double as a double, exact below 2^62."""
    return F.floor(F.when(F.abs(x) < float(1 << 62), x).otherwise(F.lit(0.0))).cast("double")


def _matrix(rows: np.ndarray) -> np.ndarray:
    return np.array(rows.tolist(), dtype=np.float64)


def choose_pivots(points: np.ndarray, number: int) -> np.ndarray:
    """Farthest-first: each pivot is the point farthest from those before it."""
    if not len(points):
        return points
    chosen, far = [0], np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < min(number, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


class CoverTree:
    """Nodes of a cover tree in preorder: centre, covering radius, members as a range of `order`, end of the subtree."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.points, self.leaf = points, leaf
        self.order = np.arange(len(points))
        self.centres: list[int] = []
        self.radii: list[float] = []
        self.ranges: list[tuple[int, int]] = []
        self.ends: list[int] = []
        if len(points):
            self._grow(0, len(points), 0)

    def _grow(self, start: int, stop: int, centre: int) -> None:
        members = self.order[start:stop]
        distance = np.linalg.norm(self.points[members] - self.points[centre], axis=1)
        radius, at = float(distance.max()), len(self.centres)
        self.centres.append(centre)
        self.radii.append(radius * (1 + 1e-12) + 1e-9)
        self.ranges.append((start, stop))
        self.ends.append(0)
        if stop - start > self.leaf and radius > 0:
            # Children are chosen far apart until they cover the members at half the radius, `CHILDREN` at most.
            owner, best, found = np.zeros(len(members), dtype=int), distance, [centre]
            while best.max() > radius / 2 and len(found) < CHILDREN:
                found.append(int(members[best.argmax()]))
                new = np.linalg.norm(self.points[members] - self.points[found[-1]], axis=1)
                owner[new < best] = len(found) - 1
                best = np.minimum(best, new)
            self.order[start:stop] = members[np.argsort(owner, kind="stable")]
            if len(found) > 1:
                edges = start + np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(found)))])
                for child, (a, b) in zip(found, zip(edges[:-1], edges[1:], strict=True), strict=True):
                    if b > a:
                        self._grow(int(a), int(b), child)
        self.ends[at] = len(self.centres)

    def children(self, node: int) -> list[int]:
        out, at = [], node + 1
        while at < self.ends[node]:
            out.append(at)
            at = self.ends[at]
        return out


class Best:
    """The best k (score, id) of each query; of equal scores the smaller id."""

    def __init__(self, queries: int, k: int, worst: np.ndarray | None = None, worst_id: np.ndarray | None = None) -> None:
        self.k = k
        self.scores = [np.zeros(0, dtype=np.float64)] * queries
        self.ids = [np.zeros(0, dtype=np.int64)] * queries
        self.worst = np.full(queries, -np.inf) if worst is None else worst.copy()
        self.worst_id = np.full(queries, np.iinfo(np.int64).max) if worst_id is None else worst_id.copy()

    def add(self, query: int, own: int, scores: np.ndarray, ids: np.ndarray) -> None:
        worst = self.worst[query]
        better = np.flatnonzero(scores >= worst)
        better = better[((scores[better] > worst) | (ids[better] <= self.worst_id[query])) & (ids[better] != own)]
        if len(better):
            scores, ids = np.concatenate([self.scores[query], scores[better]]), np.concatenate([self.ids[query], ids[better]])
            first = np.lexsort((ids, -scores))[: self.k]
            self.scores[query], self.ids[query] = scores[first], ids[first]
            if len(first) == self.k:
                self.worst[query], self.worst_id[query] = self.scores[query][-1], self.ids[query][-1]


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer products: in doubles where they are exact, else in long integers."""
    longest = max((np.square(m).sum(axis=1).max() if len(m) else 0.0) for m in (left, right))
    return left @ right.T if longest < 2.0**52 else left.astype(np.int64) @ right.astype(np.int64).T


def dual_search(queries: CoverTree, own: np.ndarray, data: CoverTree, ids: np.ndarray, best: Best) -> None:
    """All pairs of nodes whose bound reaches the worst kth score of the query node's members."""
    if not len(own) or not len(ids):
        return
    q_norm, d_norm = (np.linalg.norm(tree.points, axis=1) for tree in (queries, data))
    waiting = [(0, 0)]
    while waiting:
        q, d = waiting.pop()
        qc, dc = queries.centres[q], data.centres[d]
        members = queries.order[slice(*queries.ranges[q])]
        bound = queries.points[qc] @ data.points[dc] + q_norm[qc] * data.radii[d] + d_norm[dc] * queries.radii[q] + queries.radii[q] * data.radii[d]
        if bound * (1 + 1e-12) + 1e-6 < best.worst[members].min():
            continue
        q_next, d_next = queries.children(q), data.children(d)
        if not q_next and not d_next:
            found = data.order[slice(*data.ranges[d])]
            scores = _products(queries.points[members], data.points[found])
            for i in np.flatnonzero((scores >= best.worst[members][:, None]).any(axis=1)).tolist():
                best.add(int(members[i]), int(own[members[i]]), scores[i], ids[found])
        elif d_next and (not q_next or data.radii[d] >= queries.radii[q]):
            waiting.extend((q, child) for child in sorted(d_next, key=lambda c: queries.points[qc] @ data.points[data.centres[c]]))
        else:
            waiting.extend((child, d) for child in q_next)


_BLOCKS = (
    "node bigint, pivot bigint, dims int, centre binary, radius double, reach double, ids binary, points binary, "
    "query_ids binary, query_points binary, worst binary, worst_ids binary, found_query binary, found_vec binary, found_score binary"
)


def _builder(pivots: dict[int, np.ndarray]):
    def build(group: Arrays) -> Iterator[tuple]:
        """One row of a block: its points, its queries with the bounds from their own block, and what they found there."""
        points, ids = _matrix(group["codes"]), group["vec_id"]
        asked = np.flatnonzero(group["is_query"])
        data, queries = CoverTree(points), CoverTree(points[asked])
        best = Best(len(asked), K)
        dual_search(queries, ids[asked], data, ids, best)
        found = [np.repeat(ids[asked], [len(s) for s in best.ids]), np.concatenate([*best.ids, np.zeros(0, np.int64)]), np.concatenate([*best.scores, np.zeros(0)]).astype(np.int64)]
        centre, dims = points[data.centres[0]], points.shape[1]
        reach = float(np.linalg.norm(points - _pivot(pivots, dims, group["pivot"][0]), axis=1).max())
        packed = [ids, points, ids[asked], points[asked], best.worst, best.worst_id, *found]
        row = (group["node"][0], group["pivot"][0], dims, centre.tobytes(), data.radii[0], reach, *[a.tobytes() for a in packed])
        yield tuple(np.array([value], dtype=object) for value in row)

    return build


def _pivot(pivots: dict[int, np.ndarray], dims: int, number: int) -> np.ndarray:
    """A pivot's point; vectors of a length that the sample missed share one at the origin."""
    return pivots[dims][number - dims * PIVOTS] if dims in pivots else np.zeros(dims)


def _bound(q: np.ndarray, r: float, p: np.ndarray, s: float) -> float:
    """No product of members of two balls exceeds this."""
    bound = q @ p + np.linalg.norm(q) * s + np.linalg.norm(p) * r + r * s
    return bound + abs(bound) * 1e-12 + 1e-6


def _array(data: bytes, kind: str, dims: int = 0) -> np.ndarray:
    values = np.frombuffer(data, dtype=kind)
    return values.reshape(-1, dims) if dims else values


_FOUND = "query_id bigint, vec_id bigint, score bigint"


def _searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of a block's queries and another block; the trees of the last few blocks are kept, as a block meets many."""
    trees: dict[tuple[str, int], CoverTree] = {}

    def tree(kind: str, number: int, points: bytes, dims: int) -> CoverTree:
        if (kind, number) not in trees:
            if len(trees) >= KEPT_TREES:
                del trees[next(iter(trees))]
            trees[kind, number] = CoverTree(_array(points, "<f8", dims))
        return trees[kind, number]

    for batch in batches:
        for row in batch.itertuples(index=False):
            own, ids = _array(row.query_ids, "<i8"), _array(row.ids, "<i8")
            best = Best(len(own), K, _array(row.worst, "<f8"), _array(row.worst_ids, "<i8"))
            dual_search(tree("queries", row.asking, row.query_points, row.dims), own, tree("data", row.node, row.points, row.dims), ids, best)
            sizes = [len(found) for found in best.ids]
            if sum(sizes):
                yield pd.DataFrame({"query_id": np.repeat(own, sizes), "vec_id": np.concatenate(best.ids), "score": np.concatenate(best.scores).astype(np.int64)})


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            yield pd.DataFrame({"query_id": _array(row.found_query, "<i8"), "vec_id": _array(row.found_vec, "<i8"), "score": _array(row.found_score, "<i8")})


def blocks(vectors: DataFrame) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """The tree's blocks, of rows (vec_id, codes, is_query), and its pivots by vector length."""
    sample = sample_by_hash(vectors.select("vec_id", "codes"), "vec_id", SAMPLE).collect()
    by_length: dict[int, list] = {}
    for row in sample:
        by_length.setdefault(len(row["codes"]), []).append(row["codes"])
    pivots = {n: choose_pivots(np.array(rows), PIVOTS) for n, rows in by_length.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    @F.pandas_udf("bigint")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.zeros(len(batch), dtype=np.int64)
            lengths = batch.map(len).to_numpy()
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                if n in shared.value:
                    points, centres = _matrix(batch.to_numpy()[at]), shared.value[n]
                    far = np.square(centres).sum(axis=1)[None, :] - 2 * points @ centres.T
                    out[at] = n * PIVOTS + far.argmin(axis=1)
                else:
                    out[at] = n * PIVOTS
            yield pd.Series(out)

    placed = stored(vectors.withColumn("pivot", nearest("codes")), "placed")
    sizes = placed.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("bigint").alias("parts"))
    cut = placed.join(sizes, "pivot").withColumn("node", F.xxhash64("pivot", F.pmod(F.xxhash64("vec_id"), F.col("parts"))))
    return stored(map_groups(cut.select("node", "pivot", "vec_id", "codes", "is_query"), "node", _builder(pivots), _BLOCKS), "blocks"), pivots


def top_k(embeddings: DataFrame, is_query: Column, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the best `K` of every query among all other rows."""
    spark = embeddings.sparkSession
    batch_rows(spark, 1_000)
    vectors = embeddings.where("vec_id IS NOT NULL").select("vec_id", codes(F.col("embedding"), scale).alias("codes"), is_query.alias("is_query"))
    made, pivots = blocks(vectors.where("codes IS NOT NULL").dropDuplicates(["vec_id", "codes"]))
    asked = made.where(F.length("query_ids") > 0).select(
        F.col("node").alias("from"), "dims", "query_ids", "query_points", "worst", "worst_ids",
        F.col("centre").alias("query_centre"), F.col("radius").alias("query_radius"),
    )
    data = made.select("node", "pivot", "ids", "points", "centre", "radius")

    # The top level of the tree: at most PIVOTS rows for each vector length.
    reach = {r["pivot"]: (r["dims"], r["reach"]) for r in made.groupBy("pivot", "dims").agg(F.max("reach").alias("reach")).collect()}
    top = spark.sparkContext.broadcast([(number, dims, _pivot(pivots, dims, number), far) for number, (dims, far) in sorted(reach.items())])

    @F.pandas_udf("array<bigint>")
    def pivots_met(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for lengths, centres, radii, worsts in batches:
            out = []
            for n, centre, radius, worst in zip(lengths, centres, radii, worsts, strict=True):
                q, least = _array(centre, "<f8"), _array(worst, "<f8").min()
                out.append([number for number, dims, point, far in top.value if dims == n and _bound(q, radius, point, far) >= least])
            yield pd.Series(out)

    @F.pandas_udf("boolean")
    def may_hold(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for q_centre, q_radius, worst, centre, radius in batches:
            rows = zip(q_centre, q_radius, worst, centre, radius, strict=True)
            yield pd.Series([_bound(_array(a, "<f8"), r, _array(b, "<f8"), s) >= _array(w, "<f8").min() for a, r, w, b, s in rows])

    # A stated query set against all rows, in blocks: light summaries are tested before points travel.
    light = data.select("node", "pivot", "centre", "radius")
    met = asked.withColumn("pivot", F.explode(pivots_met("dims", "query_centre", "query_radius", "worst")))
    pairs = met.select("from", "pivot", "worst", "query_centre", "query_radius").join(light, "pivot").where("from <> node")
    pairs = stored(pairs.where(may_hold("query_centre", "query_radius", "worst", "centre", "radius")).select("from", "node"), "pairs")
    batch_rows(spark, BLOCK_ROWS)
    met = pairs.join(asked.select("from", "dims", "query_ids", "query_points", "worst", "worst_ids"), "from").join(data.select("node", "ids", "points"), "node")
    found = met.select("node", F.col("from").alias("asking"), "dims", "query_ids", "query_points", "worst", "worst_ids", "ids", "points").mapInPandas(_searched, _FOUND)
    own = made.select("found_query", "found_vec", "found_score").mapInPandas(_unpacked, _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = own.union(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= K)
    return ranked.select("query_id", "rank", "vec_id", "score")


def sql(scale: int = SCALE) -> str:
    """The rows of the query in DuckDB's SQL, for vectors of equal length."""
    return f"""WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS c FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, p.vec_id, list_inner_product(q.c, p.c)::BIGINT AS score
      FROM v q JOIN v p ON q.vec_id % 20 = 0 AND p.vec_id <> q.vec_id AND len(p.c) = len(q.c))
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
    QUALIFY rank <= {K}"""
