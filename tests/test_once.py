"""Columns of a pose that lambdas use are rows of their own in the plan."""

from posetrail.operators import pose as P


def test_centroids_and_angles_are_generated_rows(spark):
    pose = spark.createDataFrame([(0, 0, 0, [(0.0, 0.0, 1.0), (2.0, 0.0, 1.0), (4.0, 3.0, 1.0)])], f"video_id bigint, frame bigint, instance int, kps array<{P.POINT}>")
    plan = P.aligned(pose, 0, 1, 2).select("kps")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 4  # centroid, vectors, axis, angle
    row = P.with_centroid(P.with_centroid(pose)).first()
    assert (row.cx, row.cy) == (2.0, 1.0)
