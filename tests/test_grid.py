"""The dense grid of tracks, and rows that are stored once."""

from pyspark.sql import functions as F

from posetrail.operators import pose as P
from posetrail.operators import runs as R
from posetrail.operators.lineage import stored


def test_dense_grid_is_shared_by_tasks(spark):
    last = R.BLOCK + 3
    tracks = spark.range(40).select((F.col("id") % 5).alias("video_id"), (F.col("id") % 2).cast("int").alias("instance"), (F.col("id") % 4).cast("int").alias("keypoint")).distinct()
    of = spark.range(5).select(F.col("id").alias("video_id"), F.when(F.col("id") == 0, last).otherwise(F.col("id")).alias("last"))
    grid = P.dense(tracks.join(of, "video_id"))
    n = tracks.where("video_id = 0").count()
    got = {r["video_id"]: (r["n"], r["low"], r["high"], r["d"]) for r in grid.groupBy("video_id").agg(F.count("*").alias("n"), F.min("frame").alias("low"), F.max("frame").alias("high"), F.count_distinct("frame").alias("d")).collect()}
    assert got == {v: (n * (e + 1), 0, e, e + 1) for v, e in [(0, last), (1, 1), (2, 2), (3, 3), (4, 4)]}
    # every core has a share, however few bytes the tracks are
    assert grid.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_stored_rows_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = stored(spark.range(100).mapInArrow(count, "id long"))
    assert sorted(r["id"] for r in rows.collect()) == list(range(100)) and rows.count() == 100
    assert seen.value == 100
