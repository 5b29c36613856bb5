"""Centroid clustering with n-simplex projection.

Vectors become integers, floor(scale * x). Distances to a few pivots, start centroids chosen one by one for the largest
height above those before, are taken once, and are kept as apex coordinates: the place of the vector in the span of the
pivots, and its height above that span. For two vectors with such coordinates the Euclidean distance is at least that of
their apexes with both heights on the same side, and at most that with the heights on opposite sides. In a round each
vector meets the apexes of all centroids; only centroids whose lower bound does not pass the smallest upper bound are
compared, in integers. Bounds are floats and are widened by more than their rounding, so no nearest centroid is lost.

A round is one pass over the stored vectors: each task sums the vectors of its clusters, the sums of the tasks are added
per cluster and component, and only these go to the driver (centroids times components rows). Centroids, of the same
fixed number, go out with the tasks.

Components beyond 2**25 use integers of any length, and their sums are added in limbs of 30 bits. A squared distance or
inertia that no long can hold is null; the cluster is right all the same.

Kept are vectors with exactly `components` components, none null or non-finite; others have no row in the result. Ties:
equal distances go to the smaller centroid; equal hashes of ids, of repeated ids, are ordered by the vectors, ids that
are null come last. Repeated rows count and are returned each. Fewer vectors than centroids: as many centroids as
vectors. No vectors: no rows. Columns other than vec_id and embedding are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import replaced

COMPONENTS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
# Pivots at most; one is not taken if it stands less than this share of the largest height above the span of the others.
PIVOTS, LEAST_HEIGHT = 24, 1e-2
# Components up to this size are narrow: products of 64 of them fit a long.
NARROW = 1 << 25
# Widening of bounds, as a share of the distances to the first pivot that they were made from: of squares in the span,
# and of heights, which come from a difference of squares and have half its digits.
LOSS, WIDENING = 1e-10, 2e-5
LIMB = 30
LARGEST = (1 << 63) - 1
# Vectors that are compared with all centroids at a time.
BLOCK = 4_096


def _whole(x: float, scale: int) -> int:
    """floor(scale * x) as an integer of any length."""
    scaled = scale * x
    return math.floor(scaled) if math.isfinite(scaled) else int(x) * scale


def _kept(vector: Column, components: int) -> Column:
    numbers = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when((F.size(vector) == components) & finite, numbers)


@dataclass(frozen=True)
class Simplex:
    """Pivots as integers and the triangular system that turns squared distances to them into coordinates."""

    pivots: np.ndarray
    lower: np.ndarray
    squares: np.ndarray

    @classmethod
    def over(cls, points: np.ndarray, most: int) -> Simplex:
        """Pivots taken from the points: always the one highest above the span of those before it."""
        chosen = [0]
        offsets = (points - points[0]).astype(np.float64)
        rest = offsets.copy()
        heights = np.linalg.norm(rest, axis=1)
        largest = heights.max() if len(heights) else 0.0
        while len(chosen) <= most and heights.max() > LEAST_HEIGHT * largest:
            chosen.append(int(heights.argmax()))
            axis = rest[chosen[-1]] / heights[chosen[-1]]
            rest = rest - np.outer(rest @ axis, axis)
            heights = np.linalg.norm(rest, axis=1)
        edges = offsets[chosen[1:]]
        lower = np.linalg.cholesky(edges @ edges.T) if len(edges) else np.zeros((0, 0))
        return cls(points[chosen], lower, (edges * edges).sum(axis=1))

    def apexes(self, points: np.ndarray) -> np.ndarray:
        """One row each: coordinates in the span, height above it, distance to the first pivot."""
        between = np.stack([np.square((points - pivot).astype(np.float64)).sum(axis=1) for pivot in self.pivots], axis=1)
        sides = (between[:, :1] - between[:, 1:] + self.squares) / 2
        flat = np.linalg.solve(self.lower, sides.T).T if len(self.lower) else sides
        height = np.sqrt(np.maximum(between[:, 0] - np.square(flat).sum(axis=1), 0.0))
        return np.column_stack([flat, height, np.sqrt(between[:, 0])])


def bounds(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances between the vectors of two tables of apexes."""
    flat_left, flat_right = left[:, :-2], right[:, :-2]
    flat = np.square(flat_left).sum(axis=1)[:, None] + np.square(flat_right).sum(axis=1) - 2 * flat_left @ flat_right.T
    size = left[:, -1:] + right[:, -1]
    loss = LOSS * np.square(size)
    low = np.sqrt(np.maximum(flat - loss, 0.0) + np.square(left[:, -2:-1] - right[:, -2]))
    high = np.sqrt(np.maximum(flat, 0.0) + loss + np.square(left[:, -2:-1] + right[:, -2]))
    wide = WIDENING * size
    return np.maximum(low - wide, 0.0), high + wide


@dataclass(frozen=True)
class Centres:
    """The centroids of a round, their apexes and the pivots that these belong to."""

    rows: list[list[int]]
    simplex: Simplex

    def __post_init__(self) -> None:
        narrow = all(abs(x) <= NARROW for row in self.rows for x in row)
        codes = np.array(self.rows, dtype=np.int64).reshape(len(self.rows), self.simplex.pivots.shape[1]) if narrow else None
        object.__setattr__(self, "codes", codes)
        object.__setattr__(self, "apexes", self.simplex.apexes(codes) if narrow else None)

    def nearest(self, codes: np.ndarray, apexes: np.ndarray) -> tuple[np.ndarray, list[int], int]:
        """(cluster, squared distance) of each vector of narrow components, and how many pairs were compared."""
        if self.codes is None:
            found = [self.nearest_whole(row) for row in codes.tolist()]
            return np.array([c for c, _ in found], dtype=np.int64), [d for _, d in found], len(codes) * len(self.rows)
        low, high = bounds(apexes, self.apexes)
        open_ = low <= high.min(axis=1, keepdims=True)
        who, which = np.nonzero(open_)
        squares = np.square(codes[who] - self.codes[which]).sum(axis=1)
        # Pairs are ordered by vector, then centroid, so that the first smallest one is the smaller centroid.
        first = np.concatenate([[0], np.cumsum(open_.sum(axis=1))[:-1]])
        least = np.minimum.reduceat(squares, first)
        hit = np.flatnonzero(squares == least[who])
        take = hit[np.concatenate([[True], who[hit][1:] != who[hit][:-1]])]
        return which[take], least.tolist(), len(who)

    def nearest_whole(self, row: list[int]) -> tuple[int, int]:
        found = ((sum((a - b) ** 2 for a, b in zip(row, centre, strict=True)), n) for n, centre in enumerate(self.rows))
        distance, cluster = min(found)
        return cluster, distance


def _limbs(value: int) -> list[tuple[int, int]]:
    """The value in digits of 30 bits, the last one signed; narrow values have one."""
    out, at = [], 0
    while not -(1 << LIMB) < value < 1 << LIMB:
        out.append((at, value & (1 << LIMB) - 1))
        value, at = value >> LIMB, at + 1
    return [*out, (at, value)]


def _codes(batch: pa.RecordBatch, components: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("codes").to_pylist()), dtype="<i4").reshape(-1, components).astype(np.int64)


def prepared(vectors: DataFrame, simplex: Simplex, scale: int, components: int) -> DataFrame:
    """(vec_id, codes, apex, wide): codes and apex as bytes; of a vector with large components the numbers in `wide` instead."""
    schema = "vec_id bigint, codes binary, apex binary, wide array<double>"
    shape = pa.schema([("vec_id", pa.int64()), ("codes", pa.binary()), ("apex", pa.binary()), ("wide", pa.list_(pa.float64()))])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = batch.column("numbers").flatten().to_numpy(zero_copy_only=False).reshape(-1, components)
            with np.errstate(over="ignore"):
                scaled = np.floor(scale * numbers)
            narrow = (np.abs(scaled) <= NARROW).all(axis=1)
            codes = np.where(narrow[:, None], scaled, 0).astype(np.int64)
            apexes = simplex.apexes(codes)
            columns = [
                batch.column("vec_id"),
                pa.array([row.tobytes() if ok else None for row, ok in zip(codes.astype("<i4"), narrow, strict=True)], pa.binary()),
                pa.array([row.tobytes() if ok else None for row, ok in zip(apexes.astype("<f8"), narrow, strict=True)], pa.binary()),
                pa.array([None if ok else row.tolist() for row, ok in zip(numbers, narrow, strict=True)], pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=shape)

    return vectors.mapInArrow(make, schema)


def _assignments(batch: pa.RecordBatch, centres: Centres, scale: int, components: int):
    """(rows of the batch, codes, cluster, distance) of its narrow vectors by blocks, then of each wide one."""
    wide = np.array(batch.column("codes").is_null())
    rows = np.flatnonzero(~wide)
    for start in range(0, len(rows), BLOCK):
        at = rows[start : start + BLOCK]
        part = batch.take(pa.array(at))
        codes = _codes(part, components)
        apexes = np.frombuffer(b"".join(part.column("apex").to_pylist()), dtype="<f8").reshape(len(at), -1)
        clusters, distances, _ = centres.nearest(codes, apexes)
        yield at, codes, clusters, distances
    for at in np.flatnonzero(wide).tolist():
        code = [_whole(x, scale) for x in batch.column("wide")[at].as_py()]
        cluster, distance = centres.nearest_whole(code)
        yield np.array([at]), [code], np.array([cluster]), [distance]


def _sums(stored: DataFrame, centres: Centres, scale: int, components: int) -> list:
    """(cluster, component, limb, total, n) over all vectors: a task adds up its own, then tasks are added."""
    schema = "cluster int, component int, limb int, total bigint, n bigint"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centres.rows), components), dtype=np.int64)
        counts = np.zeros(len(centres.rows), dtype=np.int64)
        large: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for _, codes, clusters, _ in _assignments(batch, centres, scale, components):
                counts += np.bincount(clusters, minlength=len(counts))
                if isinstance(codes, np.ndarray):
                    np.add.at(sums, clusters, codes)
                else:
                    for component, value in enumerate(codes[0]):
                        for limb, digit in _limbs(value):
                            key = (int(clusters[0]), component, limb)
                            large[key] = large.get(key, 0) + digit
        rows = [(c, p, 0, int(sums[c, p]), int(counts[c]) if p == 0 else 0) for c in np.flatnonzero(counts).tolist() for p in range(components)]
        rows += [(*key, total, 0) for key, total in large.items()]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["cluster", "component", "limb", "total", "n"])

    added = stored.select("vec_id", "codes", "apex", "wide").mapInArrow(add, schema)
    return added.groupBy("cluster", "component", "limb").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()


def moved(centres: Centres, sums: list) -> Centres:
    """Every centroid with vectors goes to floor(sum / count) of them."""
    totals = [[0] * len(row) for row in centres.rows]
    counts = [0] * len(centres.rows)
    for row in sums:
        totals[row["cluster"]][row["component"]] += row["total"] << LIMB * row["limb"]
        counts[row["cluster"]] += row["n"]
    rows = [[x // n for x in total] if n else old for total, n, old in zip(totals, counts, centres.rows, strict=True)]
    return Centres(rows, centres.simplex)


def _long(value: int | None) -> int | None:
    return value if value is not None and value <= LARGEST else None


def assigned(stored: DataFrame, centres: Centres, scale: int, components: int) -> DataFrame:
    """(vec_id, cluster, distance) of every stored vector."""
    shape = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, clusters, distances in _assignments(batch, centres, scale, components):
                columns = [batch.column("vec_id").take(pa.array(at)), pa.array(clusters, pa.int32()), pa.array([_long(x) for x in distances], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=shape)

    return stored.mapInArrow(assign, "vec_id bigint, cluster int, distance bigint")


def cluster(vectors: DataFrame, components: int = COMPONENTS, centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE,
            seed: int = SEED, pivots: int = PIVOTS) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) of every kept vector, the final centroids)."""
    kept = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), _kept(F.col("embedding"), components).alias("numbers")).where("numbers IS NOT NULL")
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = kept.select(mark.alias("mark"), "numbers").orderBy(F.asc_nulls_last("mark"), "numbers").limit(centroids).collect()
    rows = [[_whole(x, scale) for x in row["numbers"]] for row in starts]
    narrow = [row for row in rows if all(abs(x) <= NARROW for x in row)] or [[0] * components]
    centres = Centres(rows, Simplex.over(np.array(narrow, dtype=np.int64), pivots))
    stored = replaced(prepared(kept, centres.simplex, scale, components), "apexes")
    for _ in range(rounds if rows else 0):
        centres = moved(centres, _sums(stored, centres, scale, components))
    return assigned(stored, centres, scale, components), centres.rows


def judged(vectors: DataFrame) -> DataFrame:
    """Every kept vector with its cluster, the inertia of that and of all, and the digest of its centroid."""
    found, centres = cluster(vectors)
    found = replaced(found, "assigned")
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centres]
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = found.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), exact).alias("inertia")).collect()
    within = {row["cluster"]: None if row["inertia"] is None else int(row["inertia"]) for row in sums}
    total = None if None in within.values() else sum(within.values())
    rows = [(n, _long(within.get(n)), _long(total), digest) for n, digest in enumerate(digests)]
    # A row per centroid.
    small = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql() -> str:
    """The rows of the query in DuckDB's SQL: every vector against every centroid, round by round."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS code
        FROM embeddings WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {COMPONENTS})""",
        f"""c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), code) - 1)::INT AS n, code AS centre FROM kept
        QUALIFY n < {CENTROIDS})""",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, r, code, min((d, n)) AS best FROM (SELECT k.*, n,
          list_sum(list_transform(list_zip(code, centre), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept k, c{i}) GROUP BY ALL)""")
        if i < ROUNDS:
            steps.append(f"""m{i} AS (SELECT n, list(m ORDER BY j) AS centre FROM (SELECT n, j, ((s - ((s % c) + c) % c) // c)::BIGINT AS m FROM (
              SELECT best[2] AS n, j, sum(code[j])::BIGINT AS s, count(*) AS c FROM a{i}, range(1, {COMPONENTS + 1}) g(j) GROUP BY ALL)) GROUP BY n)""")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.n, coalesce(m{i}.centre, c{i}.centre) AS centre FROM c{i} LEFT JOIN m{i} USING (n))")
    last = ROUNDS
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, best[2]::INT AS cluster, best[1]::BIGINT AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia,
      (sum(best[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(centre, ',')) AS centroid_sha256
    FROM a{last} JOIN c{last} ON n = best[2]"""
