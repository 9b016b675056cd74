"""Hand-made rows for the operators, and every registered query with SQL against DuckDB at the smallest size."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from posetrail.operators import files as O
from posetrail.operators import identity as I
from posetrail.operators import pose as P
from posetrail.operators import runs as R
from posetrail.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def series(spark, values, name="v"):
    return spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], f"video_id bigint, frame bigint, {name} int")


def poses(spark, rows):
    """rows: (frame, instance, [(x, y, conf) or None])"""
    return spark.createDataFrame([(0, f, i, [k or (None, None, None) for k in kps]) for f, i, kps in rows], f"video_id bigint, frame bigint, instance int, kps array<{P.POINT}>")


def test_spans(spark):
    f = spark.createDataFrame([(0, x) for x in (1, 2, 3, 5, 6, 9)], "video_id bigint, frame bigint")
    assert sorted((r["start"], r["end"]) for r in R.spans(f).collect()) == [(1, 3), (5, 6), (9, 9)]


def test_runs(spark):
    got = sorted((r["start"], r["end"], r["v"]) for r in R.runs(series(spark, [0, 0, 1, 1, 1, 0]), "v").collect())
    assert got == [(0, 1, 0), (2, 4, 1), (5, 5, 0)]


def test_flicker(spark):
    p = poses(spark, [(f, 0, [(1.0, 1.0, 1.0)]) for f in (0, 2, 4, 5)])
    assert sorted(r.frame for r in P.out_flicker(p).collect()) == [0, 2]


def test_roi_is_half_open(spark):
    p = P.outside_roi(poses(spark, [(0, 0, [(0.0, 0.0, 1.0), (10.0, 5.0, 1.0)])]), 0, 0, 10, 10)
    kps = p.first()["kps"]
    assert kps[0]["x"] == 0.0 and kps[1]["x"] is None


def test_interpolation_holds_edges(spark):
    v = spark.createDataFrame([(0, 1, 1.0), (0, 3, 3.0)], "video_id bigint, frame bigint, x double")
    grid = spark.createDataFrame([(0, f) for f in range(5)], "video_id bigint, frame bigint")
    got = [r.x for r in R.interpolated(v, grid, ("x",), ("video_id",)).orderBy("frame").collect()]
    assert got == [1, 1, 2, 3, 3]


def test_bbox_padding(spark):
    b = P.bbox(poses(spark, [(0, 0, [(0.0, 0.0, 1.0), (10.0, 10.0, 1.0)])]), 10).first()
    assert (b.x1, b.x2) == (-1.0, 11.0)


def test_names_that_do_not_parse_are_null(spark):
    t = spark.createDataFrame([("a/img00000012.png", "20240103"), ("a/other.png", "no day"), (None, None)], "p string, d string")
    got = t.select(O.image_frame("p").alias("f"), O.day_number("d", "2024-01-01").alias("n"), O.prediction_name("p", r"^(a)/(img)")[0].alias("v")).collect()
    assert [tuple(r) for r in got] == [(12, 3, "a"), (None, 1, None), (None, 1, None)]


def test_gap_with_one_bound_is_left(spark):
    track = spark.createDataFrame([(0, 0, 1, 1.0), (0, 0, 5, 9.0), (0, 1, 1, 1.0)], "video_id bigint, instance int, frame bigint, x double")
    gaps = spark.createDataFrame([(0, 0, 2, 4), (0, 1, 2, 4)], "video_id bigint, instance int, start bigint, end bigint")
    assert sorted((r.instance, r.frame, r.x) for r in O.fill_gap(track, gaps, ("x",)).collect()) == [(0, 2, 3.0), (0, 3, 5.0), (0, 4, 7.0)]


def test_change_buffer(spark):
    s = series(spark, [1, 1, 2, 2, 2])
    got = R.buffered(R.changes(s, "v"), 1, s.groupBy("video_id").agg(F.max("frame").alias("last")))
    assert sorted(r.frame for r in got.collect()) == [1, 2, 3]


def test_short_bouts_tie_goes_left(spark):
    got = sorted((r["start"], r["end"], r["v"]) for r in R.short_bouts(series(spark, [1, 1, 1, 2, 3, 3, 3]), "v", 2).collect())
    assert got == [(0, 3, 1), (4, 6, 3)]


def test_absent_pose_and_empty_table(spark):
    p = poses(spark, [(0, 0, [None, None])])
    assert P.with_centroid(p).first()["cx"] is None
    assert P.out_size(p).where("out").count() == 0
    assert P.out_duplicate(p.limit(0)).count() == 0
    assert R.spans(p.limit(0)).count() == 0


def test_rigid_fill_reproduces_a_turned_pose(spark):
    canon = np.array([[20.0, 0], [0, 0], [-20, 0], [14, 8]])
    turn = np.array([[np.cos(0.7), -np.sin(0.7)], [np.sin(0.7), np.cos(0.7)]])
    at = canon @ turn.T + [100, 50]
    p = poses(spark, [(0, 0, [(float(x), float(y), 0.9) for x, y in at[:3]] + [None])])
    c = spark.createDataFrame([(0, k, float(x), float(y)) for k, (x, y) in enumerate(canon)], "video_id bigint, keypoint int, cx double, cy double")
    k = I.fill_missing(p, c, 3).first()["kps"][3]
    assert np.allclose((k["x"], k["y"]), at[3]) and k["conf"] == 1.0


def test_swap_twice_is_identity(spark):
    p = poses(spark, [(f, i, [(float(f), float(i), 1.0)]) for f in range(6) for i in (0, 1)])
    orders = spark.createDataFrame([(0, 2, "t"), (0, 2, "t"), (0, 4, "i")], "video_id bigint, frame bigint, kind string")
    got = {(r.frame, r.instance): r.kps[0]["y"] for r in I.swap_orders(p, orders).collect()}
    assert all((got[f, i] != i) == (f == 4) for f, i in got)


def test_sweep_pieces_are_independent(spark):
    """A silence of over ten frames resets the state: sweeping the pieces apart changes nothing."""
    rows = [(0, f, i, 10.0 * (i if f % 7 else 1 - i) + f % 3, 0.0) for f in [*range(20), *range(40, 60)] for i in (0, 1)]
    schema = "video_id bigint, frame bigint, instance int, cx double, cy double"
    size = spark.createDataFrame([(0, 5.0)], "video_id bigint, body_length double")
    whole = {tuple(r) for r in I.motion_sweep(spark.createDataFrame(rows, schema), size).collect()}
    parts = {tuple(r) for part in (lambda f: f < 30, lambda f: f >= 30) for r in I.motion_sweep(spark.createDataFrame([x for x in rows if part(x[1])], schema), size).collect()}
    assert whole == parts and any(r[2] for r in whole)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    if name not in registry.oracle_sql():
        assert len(got)
        return
    want = duck.execute(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    got, want = (t[columns].sort_values(columns).reset_index(drop=True) for t in (got, want))
    for c in columns:
        if got[c].dtype.kind in "fiub":
            assert np.allclose(got[c].astype(float), want[c].astype(float), atol=2e-6, equal_nan=True), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c


def test_entry(spark):
    assert entry.entry(spark).columns == ["video_id", "start", "end"]


def test_first_named(spark):
    names = spark.createDataFrame([(["Ear_L", "Mid", "SNOUT", "Hip R"],), (["tail base", "Nose-tip"],), (["a"],), ([],)], "names array<string>")
    got = names.select(O.first_named("names", O.HEAD_NAMES), O.first_named("names", O.TAIL_NAMES)).collect()
    assert [tuple(r) for r in got] == [(2, 3), (1, 0), (None, None), (None, None)]


def test_undistortion_undoes_the_lens(spark):
    (k1, k2, p1, p2), places = (0.05, 0.01, 0.001, -0.002), [(x / 10, y / 10) for x in (-3, 0, 2) for y in (-2, 1)]
    bent = []
    for x, y in places:
        r = x * x + y * y
        bent.append(tuple(800 * v + 300 for v in (x * (1 + k1 * r + k2 * r * r) + 2 * p1 * x * y + p2 * (r + 2 * x * x), y * (1 + k1 * r + k2 * r * r) + p1 * (r + 2 * y * y) + 2 * p2 * x * y)))
    got = I.undistorted(spark.createDataFrame(bent, "x double, y double"), (800.0, 800.0, 300.0, 300.0), (k1, k2, p1, p2), 12).collect()
    assert np.allclose([tuple(r) for r in got], [(800 * x + 300, 800 * y + 300) for x, y in places])


def test_agreement_flips_a_mostly_crossed_video(spark):
    s = spark.createDataFrame([(0, f, c, 1 - c if f < 3 else c, 0.9) for f in range(4) for c in (0, 1)] + [(0, 9, 0, 0, 0.1)], "video_id bigint, frame bigint, cluster int, motion_id int, confidence double")
    assert sorted((r.frame, r.agreement) for r in I.agreement(s).collect()) == [(0, 1.0), (1, 1.0), (2, 1.0), (3, 0.0)]
