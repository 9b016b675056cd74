"""Cosines of segments in tiles and convolution in blocks, against numpy on whole arrays."""

import random

import numpy as np
from pyspark.sql import functions as F

from posetrail.operators import learning as E
from posetrail.operators import runs as R


def test_pair_statistics_in_tiles(spark, monkeypatch):
    """Segments of less and more rows than a tile, one of one row, one of one id, equal vectors, a zero and a null vector."""
    monkeypatch.setattr(E, "TILE_ROWS", 7)
    rng = np.random.default_rng(1)
    rows = [(s, s * 1000 + k, k % 2 if s else 0, rng.normal(size=5).tolist()) for s, n in enumerate((9, 40, 1, 23)) for k in range(n)]
    rows += [(1, 1900 + k, k % 2, rows[12][3]) for k in range(4)]
    odd = [(1, 1990, 0, [0.0] * 5), (3, 3990, 1, None)]
    got = {(r.segment, r.same): r for r in E.pair_statistics(spark.createDataFrame(rows + odd, "segment int, vec_id long, motion_id int, embedding array<double>")).collect()}
    want: dict = {}
    for i, (s, a, m, x) in enumerate(rows):
        for t, b, n, y in rows[:i]:
            if s == t and a != b:
                want.setdefault((s, m == n), []).append(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
    assert set(got) == set(want)
    for key, v in want.items():
        assert got[key].n == len(v) and np.allclose([got[key]["mean"], got[key].p30, got[key].p70], [np.mean(v), *np.percentile(v, [30, 70])])


def test_smoothing_over_blocks(spark, monkeypatch):
    """One video over many blocks, one shorter than the kernel's reach, one that ends just behind a block, gaps between scores."""
    monkeypatch.setattr(E, "BLOCK", 64)
    monkeypatch.setattr(R, "BLOCK", 50)
    rng = random.Random(2)
    sizes = {0: 1500, 1: 5, 2: 129, 3: 64}
    known = {(v, f): rng.random() for v, n in sizes.items() for f in range(n) if rng.random() < 0.3 or f == 2}
    scores = spark.createDataFrame([(*k, x) for k, x in known.items()], "video_id long, frame long, s double")
    grid = spark.createDataFrame([(v, f) for v, n in sizes.items() for f in range(n)], "video_id long, frame long")
    for sigma in (2.0, 15.0):
        got = {(r.video_id, r.frame): r.s for r in E.smoothed(scores, grid, "s", sigma).collect()}
        reach = int(4 * sigma + 0.5)
        kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
        for v, n in sizes.items():
            at = sorted(f for w, f in known if w == v)
            line = np.interp(np.arange(n), at, [known[v, f] for f in at])
            want = np.convolve(np.pad(line, reach, mode="edge"), kernel / kernel.sum(), mode="valid")
            assert np.allclose([got[v, f] for f in range(n)], want), v
    assert E.smoothed(scores.limit(0), grid, "s").count() == 0


def test_a_long_video_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 1000)
    grid = spark.range(30_000).select(F.lit(0).alias("video_id"), F.col("id").alias("frame"))
    out = E.smoothed(grid.withColumn("s", F.rand(1)), grid, "s", 10.0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(counts) == 30_000 and max(counts) <= 15_000
