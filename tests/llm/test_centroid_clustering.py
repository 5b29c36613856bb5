"""Clustering against plain loops over integers, and its edge cases."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logtide.llm import simplex

ROWS = "vec_id bigint, embedding array<double>"


def plainly(rows, components, centroids, rounds, scale=simplex.SCALE, seed=simplex.SEED):
    """Every vector against every centroid in integers of any length."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    coded = [(i, [math.floor(scale * x) if math.isfinite(scale * x) else int(x) * scale for x in v], v) for i, v in kept]
    mark = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    centres = [c for _, c, _ in sorted(coded, key=lambda r: (r[0] is None, "" if r[0] is None else mark(r[0]), r[2]))[:centroids]]
    nearest = lambda c: min((sum((a - b) ** 2 for a, b in zip(c, m, strict=True)), n) for n, m in enumerate(centres))
    for _ in range(rounds):
        found = [nearest(c)[1] for _, c, _ in coded]
        for n in range(len(centres)):
            mine = [c for (_, c, _), k in zip(coded, found, strict=True) if k == n]
            if mine:
                centres[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(i, nearest(c)[1], nearest(c)[0]) for i, c, _ in coded]
    return sorted(out, key=repr), centres


def _run(spark, rows, components, centroids, rounds, **extra):
    frame = spark.createDataFrame(rows, ROWS).withColumns({k: F.lit(v) for k, v in extra.items()})
    made, centres = simplex.cluster(frame, components, centroids, rounds)
    return sorted(map(tuple, made.collect()), key=repr), centres


@pytest.mark.parametrize("kind", ["spread", "lattice", "copies"])
def test_equals_plain_loops(spark, kind):
    rng = np.random.default_rng(8)
    points = {
        "spread": rng.standard_normal((300, 6)) * 5,
        "lattice": rng.integers(-2, 3, (300, 6)) / 256,
        "copies": np.repeat(rng.standard_normal((5, 6)), 60, axis=0),
    }[kind]
    rows = [(i // 2 if kind == "copies" else i, v) for i, v in enumerate(points.tolist())]
    assert _run(spark, rows, 6, 12, 4, numbers="x", apex=1, cluster=2) == plainly(rows, 6, 12, 4)


def test_unusable_large_and_null_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v) for i, v in enumerate((rng.standard_normal((40, 4)) * 3).tolist())]
    rows += [(50, [1e300, -1e300, 2.0, 0.0]), (51, [1e307, 1.0, 1.0, 1.0]), (52, [3e5, -3e5, 1e6, 7.5])]
    rows += [(60, None), (61, []), (62, [1.0, None, 2.0, 3.0]), (63, [1.0, float("nan"), 2.0, 3.0]), (64, [float("inf"), 1.0, 1.0, 1.0]), (65, [1.0] * 5)]
    rows += [(None, [0.5, 0.5, 0.5, 0.5]), (3, rows[3][1])]
    for centroids in (3, 60):
        wanted, centres = plainly(rows, 4, centroids, 3)
        found, moved = _run(spark, rows, 4, centroids, 3)
        assert moved == centres
        assert found == sorted(((i, c, d if d < 1 << 63 else None) for i, c, d in wanted), key=repr)


def test_bounds_hold_the_distance():
    rng = np.random.default_rng(5)
    for scale in (1, 300, 1 << 20):
        points = np.floor(rng.standard_normal((400, 64)) * scale).astype(np.int64)
        points[200:] = points[:1] + rng.integers(0, 3, (200, 64))
        made = simplex.Simplex.over(points[:40], simplex.PIVOTS)
        apexes = made.apexes(points)
        low, high = simplex.bounds(apexes, apexes[:50])
        true = np.sqrt(np.square((points[:, None] - points[None, :50]).astype(float)).sum(axis=2))
        assert (low <= true).all() and (true <= high).all()


def test_far_centroids_are_not_compared():
    rng = np.random.default_rng(6)
    middles = rng.standard_normal((40, 64)) * 400
    points = np.floor(np.repeat(middles, 20, axis=0) + rng.standard_normal((800, 64)) * 5).astype(np.int64)
    centres = simplex.Centres(np.floor(middles).astype(np.int64).tolist(), simplex.Simplex.over(np.floor(middles).astype(np.int64), simplex.PIVOTS))
    clusters, _, compared = centres.nearest(points, centres.simplex.apexes(points))
    assert (clusters == np.repeat(np.arange(40), 20)).all() and compared < 800 * 40 / 4


def test_no_vectors(spark):
    assert simplex.judged(spark.createDataFrame([], ROWS)).count() == 0
    assert simplex.judged(spark.createDataFrame([(1, None)], ROWS)).count() == 0
