"""Means that tie with a threshold: the SQL sums in the operators' order, however the rows lie."""

import duckdb
import pytest

import __spark_entry__ as entry
from posetrail.operators import pose as P
from posetrail.plans import pose_queries as Q

CONFS = [(0.05, 0.97, 0.44, 0.14), (0.69, 0.87, 0.03, 0.01), (0.7, 0.6, 0.2, 0.1), (0.1, 0.2, 0.6, 0.7), (0.8, 0.01, 0.13, 0.66)]


@pytest.mark.parametrize("query", ["out_confidence", "out_combine", "mrk_outlier", "fix_average_pose"])
def test_mean_confidences_of_sql_do_not_depend_on_the_order_of_rows(spark, query):
    rows = [(0, f, 0, [(0.0, 0.0, c) for c in cs]) for f, cs in enumerate(CONFS)]
    pose = spark.createDataFrame(rows, f"video_id bigint, frame bigint, instance int, kps array<{P.POINT}>")
    want = {r.frame: r.m for r in pose.select("frame", P._mean(P.F.transform("kps", P._of("conf"))).alias("m")).collect()}
    sql = entry.oracle_sql()[query]
    assert Q.MEAN_CONF in sql
    assert "avg(conf) c " not in sql and "not avg(conf)" not in sql
    for way in (1, -1):
        c = duckdb.connect(config={"threads": 1})
        c.execute("create table pose_long (video_id bigint, frame bigint, instance int, keypoint int, x double, y double, conf double)")
        c.executemany("insert into pose_long values (0, ?, 0, ?, 0, 0, ?)", [(f, k, v) for f, cs in enumerate(CONFS) for k, v in list(enumerate(cs))[::way]])
        assert dict(c.execute(f"with {Q.INST} select frame, c from inst").fetchall()) == want
