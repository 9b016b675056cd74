"""Tracks filled by blocks against the general interpolation over a dense grid, with nulls, holes of whole blocks and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from posetrail.operators import pose as P
from posetrail.operators import repair as M
from posetrail.operators import runs as R
from posetrail.operators import tracks as T

KEY = ["video_id", "instance", "keypoint"]
DDL = "video_id bigint, instance int, keypoint int, frame bigint, x double, y double, conf double"


@pytest.fixture(scope="module")
def long(spark):
    rng, rows = random.Random(4), []
    for v, last in ((1, 3 * T.FRAMES + 50), (2, T.FRAMES - 1), (3, T.FRAMES), (4, 40)):
        for i in (0, 1):
            f = rng.choice((0, 7))
            while f <= last:
                some = lambda: rng.choice((None, rng.randint(0, 99) / 7))
                rows += [(v, i, k, f, some(), some(), some()) for k in range(3) if rng.random() < 0.7]
                f += rng.choice((1, 1, 1, 2, 3, 5, 9)) if v > 1 else rng.choice((1, 2, 40, 90, 700 + (i * 9000 if f < 2000 else 0)))
    rows += [(4, 5, 0, 3, None, None, None), (4, None, 1, 4, 1.0, 2.0, 3.0), (4, 1, 9, None, 5.0, 5.0, 5.0), (4, 1, 8, -3, 5.0, 5.0, 5.0), (5, 0, 0, None, 1.0, 1.0, 1.0), (None, 0, 0, 1, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, DDL).repartition(5).cache()


def general(long, max_gap):
    last = long.groupBy("video_id").agg(F.max("frame").alias("last"))
    grid = P.dense(long.select(*KEY).distinct().join(last, "video_id"))
    return R.interpolated(long, grid, ("x", "y", "conf"), tuple(KEY), max_gap, ("video_id", "instance")).select(*KEY, "frame", "x", "y", "conf")


def ordered(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("max_gap", [0, 3, 60])
def test_blocks_fill_as_the_grid_does(long, max_gap):
    got = P.interpolated(long, max_gap)
    assert got.columns == [*KEY, "frame", "x", "y", "conf"]
    assert ordered(got) == ordered(general(long, max_gap))


@pytest.mark.parametrize("least", [1, 5])
def test_complete_frames(long, least):
    filled = general(long, 3)
    want = ordered(M.complete_frames(filled, 2, least).select("video_id", "frame", "row"))
    assert ordered(T.complete(long, 3, 2, least)) == want and want
    rows = T.complete(long, 3, 2, least)
    assert ordered(T.interpolated(long, 3, 2, least)) == ordered(filled.join(rows, ["video_id", "frame"]).select(*KEY, "frame", "x", "y", "conf", "row"))


def test_repeated_rows_stay(spark):
    rows = [(1, 0, 0, 0, 1.0, 1.0, None), (1, 0, 0, 2, 3.0, None, 0.5), (1, 0, 0, 2, 5.0, 7.0, 0.5)]
    got = P.interpolated(spark.createDataFrame(rows, DDL)).collect()
    assert sorted((r.frame, r.x) for r in got if r.frame == 2) == [(2, 3.0), (2, 5.0)] and len(got) == 4
    assert {(r.frame, r.y) for r in got if r.frame != 1} == {(0, 1.0), (2, 7.0)}


@pytest.mark.parametrize("query", ["trk_interp_all", "exp_infer"])
def test_the_grid_is_not_moved(spark, query):
    """Rows go to their blocks before they become a row a keypoint; nothing that is made of them is dealt again (26 shuffles before, 8 and a join for exp_infer)."""
    plan = entry.queries()[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("Exchange hashpartitioning") <= 6 and "SortMergeJoin" not in plan
