"""Average poses, absent animals, edits, learning measures, blobs and triangulation against plain calculations; files of odd forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from posetrail.operators import identity as I
from posetrail.operators import learning as E
from posetrail.operators import pose as P
from posetrail.operators import repair as M
from posetrail.plans.identity_queries import CAMS
from posetrail.sources import annotations as T
from posetrail.sources import poses as S
from posetrail.sources import projects as J

SHAPE = np.array([[20.0, 0], [0, 0], [-20, 0], [14, 8]])


def table(spark, poses):
    """{(frame, instance): array of (x, y, conf), NaN for absent}"""
    rows = [(0, f, i, [tuple(None if math.isnan(v) else float(v) for v in p) for p in kps]) for (f, i), kps in poses.items()]
    return spark.createDataFrame(rows, f"video_id bigint, frame bigint, instance int, kps array<{P.POINT}>")


def moving(frames, absent, seed=1):
    rng, out = np.random.default_rng(seed), {}
    for f in range(frames):
        for i in (0, 1):
            if (f, i) in absent:
                continue
            a = 0.02 * f + i
            turn = np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]])
            kps = np.column_stack([SHAPE @ turn.T + [100 + f, 50 + 100 * i] + rng.normal(0, 0.5, (4, 2)), rng.uniform(0.2, 1, 4)])
            kps[rng.random(4) < 0.15] = np.nan
            out[f, i] = kps
    return out


def averaged(poses, total, frame, instance):
    def usable(k):
        n = np.isfinite(k[:, 0]).sum()
        return n >= 3 and np.nanmean(k[:, 2]) >= 0.5

    def angle(k):
        vectors = [k[b, :2] - k[a, :2] for a, b in ((1, 0), (2, 0), (2, 1)) if np.isfinite(k[[a, b], 0]).all()]
        t = [math.atan2(v[1], v[0]) for v in vectors]
        return math.atan2(sum(map(math.sin, t)), sum(map(math.cos, t)))

    half = 30
    for _ in range(10):
        low, high = frame - half, frame + half + 1
        shift = -low if low < 0 else total - high if high > total else 0
        inside = range(max(0, low + shift), min(total, high + shift))
        found = [poses[f, instance] for f in inside if (f, instance) in poses and usable(poses[f, instance])]
        if len(found) > 30:
            centres = [np.nanmean(k[:, :2], axis=0) for k in found]
            turns = [angle(k) for k in found]
            local = [(k[:, :2] - c) @ np.array([[math.cos(-t), math.sin(-t)], [-math.sin(-t), math.cos(-t)]]) for k, c, t in zip(found, centres, turns, strict=True)]
            mean, t = np.nanmean(local, axis=0), math.atan2(np.mean(np.sin(turns)), np.mean(np.cos(turns)))
            return mean @ np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]]) + np.mean(centres, axis=0), np.nanmean([k[:, 2] for k in found], axis=0)
        half *= 2
    return None


@pytest.mark.filterwarnings("ignore:Mean of empty slice")
def test_average_poses_and_absent_animals(spark):
    total = 300
    absent = {(f, 1) for f in [5, 150, 151, 298, *range(60, 120)]} | {(f, 0) for f in range(20, 290)}
    poses = moving(total, absent)
    pose, size = table(spark, poses), spark.createDataFrame([(0, total)], "video_id bigint, total bigint")
    asked = [(0, f, 1) for f in (5, 150, 90, 298, 0)] + [(0, 100, 0)]
    got = {(r.frame, r.instance): np.array([(p["x"], p["y"], p["conf"]) for p in r.kps]) for r in M.average_pose(pose, spark.createDataFrame(asked, "video_id bigint, frame bigint, instance int"), size, 0, 1, 2).collect()}
    for _, f, i in asked:
        want = averaged(poses, total, f, i)
        assert (want is None) == ((f, i) not in got), (f, i)
        if want is not None:
            assert np.allclose(got[f, i][:, :2], want[0]) and np.allclose(got[f, i][:, 2], want[1])
    assert (100, 0) not in got
    put = M.average_pose(pose, spark.createDataFrame([(0, 150, 1, 7.0, 8.0)], "video_id bigint, frame bigint, instance int, cx double, cy double"), size, 0, 1, 2).first()
    move = averaged(poses, total, 150, 1)[0] - [(p["x"], p["y"]) for p in put.kps]
    assert np.allclose(move, move[0]) and not np.allclose(move[0], 0)
    canon = spark.createDataFrame([(0, k, float(x), float(y)) for k, (x, y) in enumerate(SHAPE)], "video_id bigint, keypoint int, cx double, cy double")
    full = {(r.frame, r.instance): r.kps for r in M.fill_absent(pose, size, 2, canon, 0, 1, 2).collect()}
    assert set(full) == {(f, i) for f in {f for (f, _), k in poses.items() if np.isfinite(k).any()} for i in (0, 1)}
    assert np.allclose([(p["x"], p["y"]) for p in full[5, 1]], averaged(poses, total, 5, 1)[0])
    assert np.allclose([(p["x"], p["y"]) for p in full[130, 0]], SHAPE + 200)


@pytest.mark.filterwarnings("ignore:Mean of empty slice")
def test_average_poses_over_blocks_of_a_track(spark, monkeypatch):
    monkeypatch.setattr(M, "TRACK", 64)
    test_average_poses_and_absent_animals(spark)


@pytest.mark.parametrize("query", ["fix_average_pose", "fix_missing_inst"])
def test_average_poses_move_poses_once(spark, query):
    """Poses go to their tracks by one shuffle, beside those of small tables; 31 and 53 before."""
    plan = entry.queries()[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") <= 10


def test_moves_and_deletions_of_keypoints(spark):
    nan = float("nan")
    p = table(spark, {(0, 0): np.array([[1.0, 2, 0.5], [nan] * 3]), (1, 0): np.array([[3.0, 4, 0.5], [5, 6, 0.7]])})
    e = spark.createDataFrame([(0, 0, 0, 1, 9.0, 8.0), (0, 1, 0, None, 1.0, 1.0)], "video_id bigint, frame bigint, instance int, keypoint int, dx double, dy double")
    got = {r.frame: [tuple(k) for k in r.kps] for r in M.move_poses(p, e).collect()}
    assert got == {0: [(1.0, 2.0, 0.5), (9.0, 8.0, 1.0)], 1: [(4.0, 5.0, 0.5), (6.0, 7.0, 0.7)]}
    gone = spark.createDataFrame([(0, 0, 0, 0, None), (0, 1, 1, 0, 1)], "video_id bigint, start bigint, end bigint, instance int, keypoint int")
    assert [(r.frame, [tuple(k) for k in r.kps]) for r in M.delete_tracks(p, gone).collect()] == [(1, [(3.0, 4.0, 0.5), (None, None, None)])]


def test_ranges_reach_their_frames_by_blocks(spark):
    """A range has a row for each block, not for each frame; ranges cross blocks, overlap, repeat and cancel, and null instances match nothing."""
    frames = (0, 1, 255, 256, 300, 511, 512, 513, 2_000_000)
    p = table(spark, {(f, i): np.array([[f, i, 0.5], [1.0, 2.0, 0.6]]) for f in frames for i in (0, 1, 2)})
    swaps = [(1, 300, 5), (255, 512, 5), (255, 512, 5), (256, 256, 5), (512, -1, 513), (7, 6, 5), (None, 9, 5)]
    e = spark.createDataFrame([(0, *x) for x in [*swaps, (0, 2_200_000, 5)]], "video_id bigint, start bigint, end bigint, last bigint")
    got = {(r.frame, r.instance): r.kps[0]["y"] for r in M.swap_tracks(p, e).collect()}
    odd = lambda f: (1 + sum(a is not None and a <= f <= (last if b == -1 else b) for a, b, last in swaps)) % 2
    assert got == {(f, 1 - i if odd(f) and i < 2 else i): i for f in frames for i in (0, 1, 2)}
    assert M._edited(e, odd=True).count() <= 2_200_000 // M.EDITED + 1
    gone = [(0, 255, 1, None), (255, 600, 0, 1), (300, 2_200_000, 2, 0), (511, 512, 2, 1), (511, 512, 2, 0), (0, 9999, None, None)]
    e = spark.createDataFrame([(0, *x) for x in gone], "video_id bigint, start bigint, end bigint, instance int, keypoint int")
    left = {(r.frame, r.instance): [k["x"] is not None for k in r.kps] for r in M.delete_tracks(p, e).collect()}
    on = lambda f, i, k: any(a <= f <= b and i == j and k == m for a, b, j, m in gone)
    assert left == {(f, i): [not on(f, i, k) for k in (0, 1)] for f in frames for i in (0, 1, 2) if not on(f, i, None)}


def test_triplets_of_each_mode(spark):
    rng = np.random.default_rng(3)
    rows = [(s * 20 + k, s, k % 2, [float(v) for v in rng.normal(size=6) + 2 * (k % 2)]) for s in range(3) for k in range(20)]
    e = spark.createDataFrame(rows, "vec_id bigint, segment bigint, motion_id int, embedding array<double>")
    x = {r[0]: np.array(r[3]) / np.linalg.norm(r[3]) for r in rows}
    for mode in ("hard", "median", "semihard"):
        got = {(r.segment, r.anchor): (r.positive, r.negative) for r in E.triplets(e, mode, most=12).collect()}
        want = {}
        for s in range(3):
            ids = range(s * 20, s * 20 + 20)
            sims = {(a, b): float(x[a] @ x[b]) for a in ids for b in ids if a != b}
            p30 = np.percentile([v for (a, b), v in sims.items() if a < b and a % 2 == b % 2], 30)
            p70 = np.percentile([v for (a, b), v in sims.items() if a < b and a % 2 != b % 2], 70)
            for a in ids:
                pos = [b for b in ids if b != a and b % 2 == a % 2 and sims[a, b] < p30]
                neg = [b for b in ids if b % 2 != a % 2 and sims[a, b] > p70]
                if not pos or not neg or sum(k[0] == s for k in want) >= 13 // 3 + 1:
                    continue
                if mode == "hard":
                    want[s, a] = (min(pos, key=lambda b: sims[a, b]), max(neg, key=lambda b: sims[a, b]))
                elif mode == "median":
                    want[s, a] = (pos[len(pos) // 2], neg[len(neg) // 2])
                else:
                    want[s, a] = tuple(min(c, key=lambda b: abs(sims[a, b] - (t + end(sims[a, k] for k in c)) / 2)) for c, t, end in ((pos, p30, min), (neg, p70, max)))
        assert got == want, mode
    assert E.triplets(e, "random", most=12).count() == len(want)


def test_bimodality_of_two_hills_and_one(spark):
    rng = np.random.default_rng(4)
    two = np.concatenate([rng.normal(0, 1, 3000), rng.normal(12, 1, 3000)])
    one = rng.normal(0, 1, 3000)
    df = lambda v: spark.createDataFrame([(float(x),) for x in v], "d double")
    got = E.bimodality(df(two), "d")
    assert got["bimodal"] and got["score"] > 0.9 and got["valley_depth"] > 0.95 and 0.8 < got["peak_ratio"] <= 1
    # the kernel estimate on the points themselves
    width = 0.2 * two.std(ddof=1)
    grid = np.linspace(two.min() - 0.1 * np.ptp(two), two.max() + 0.1 * np.ptp(two), 1000)
    y = np.exp(-0.5 * ((grid[:, None] - two) / width) ** 2).sum(axis=1)
    (i, _), (j, _) = E.peaks(y, 0.25 * y.max(), 50)
    assert math.isclose(got["valley_depth"], 1 - y[i : j + 1].min() / ((y[i] + y[j]) / 2), rel_tol=1e-3)
    assert not E.bimodality(df(one), "d")["bimodal"] and not E.bimodality(df([1.0] * 100), "d")["bimodal"] and not E.bimodality(df([]), "d")["bimodal"]


def test_triangulation_confidence(spark):
    rng, rows, want = np.random.default_rng(5), [], {}
    p = np.array(CAMS).reshape(-1, 3, 4)
    for k in range(60):
        point = np.array([*rng.uniform(-200, 200, 2), rng.uniform(0, 100), 1])
        seen = []
        for c in range(3):
            if rng.random() < 0.85:
                h = p[c] @ point
                seen.append((c, h[0] / h[2] + rng.normal(0, 3), h[1] / h[2] + rng.normal(0, 3), rng.uniform(0.1, 1)))
        rows += [(k, c, *map(float, s)) for c, *s in seen]
        if len(seen) < 2:
            continue
        a = np.array([w * (m * p[c][2] - p[c][r]) for c, u, v, w in seen for r, m in ((0, u), (1, v))])
        _, s, h = np.linalg.svd(a)
        h = h[-1] / h[-1][3]
        back = [p[c] @ h for c, *_ in seen]
        error = sum(w * math.hypot(b[0] / b[2] - u, b[1] / b[2] - v) for b, (_, u, v, w) in zip(back, seen, strict=True)) / sum(w for *_, w in seen)
        want[k] = (*h[:3], 0.7 * min(max(1 - error / 10, 0), 1) + 0.3 * min(max(100 / (s[0] / (s[-1] + 1e-10)), 0), 1))
    views = spark.createDataFrame(rows, "k int, cam int, u double, v double, conf double")
    cams = spark.createDataFrame(list(enumerate(CAMS)), "cam int, p array<double>")
    got = {r.k: (r.x, r.y, r.z, r.confidence) for r in I.triangulate(views, cams, ["k"]).collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], rtol=1e-5) for k in want)


def test_even_segments(spark):
    f = spark.createDataFrame([(0, x, x % 3 != 0, True) for x in range(100)] + [(0, x, True, True) for x in range(200, 203)], "video_id bigint, frame bigint, eligible boolean, safe boolean")
    got: dict = {}
    for r in E.segments(f, chunk=60, share=0.4).orderBy("frame").collect():
        got.setdefault(r.segment, []).append(r.frame)
    want = [[x for x in range(60) if x % 3], [x for x in range(60, 100) if x % 3]]
    pick = lambda c: [c[i] for i in np.linspace(0, len(c) - 1, max(int(len(c) * 0.4), 10), dtype=int)]
    assert got == {0: pick(want[0]), 1: pick(want[1])}


# --- files ---

PROJECT = J.Project(("nose", "tail"), ("a", "b"), "who", True)


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_wide_files_of_other_orders(spark, tmp_path):
    """Keypoints in another order, image paths over three cells, negative and empty cells, rows that are no frames."""
    text = "scorer,,,m,m,m,m,m,m,m,m\nindividuals,,,a,a,a,a,b,b,b,b\nbodyparts,,,tail,tail,nose,nose,tail,tail,nose,nose\ncoords,,,x,y,x,y,x,y,x,y\n"
    text += "labeled-data,v,img00000007.png,1,2,3,4,,,-5,6\nlabeled-data,v,other.png,1,2,3,4,5,6,7,8\n"
    with pytest.raises(ValueError):  # the frame's cell is the first one: here headers are three cells wide
        S.read_poses(spark, write(tmp_path, "no.csv", "1,2,3\n"), PROJECT)
    got = {r.instance: [tuple(k) for k in r.kps] for r in S.read_poses(spark, write(tmp_path, "a.csv", text), PROJECT).collect()}
    assert got == {0: [(3.0, 4.0, 1.0), (1.0, 2.0, 1.0)], 1: [(None, 6.0, None), (None, None, None)]}
    with pytest.raises(ValueError, match="columns"):
        S.read_poses(spark, write(tmp_path, "b.csv", "bodyparts,nose,nose\ncoords,x,y\n0,1,2\n"), J.Project(("nose", "tail")))
    one = S.read_poses(spark, write(tmp_path, "c.csv", "scorer,m,m,m\nbodyparts,nose,nose,nose\ncoords,x,y,likelihood\n0,1,2,0.5\n1,,,\n"), J.Project(("nose",))).collect()
    assert [(r.frame, tuple(r.kps[0])) for r in one] == [(0, (1.0, 2.0, 0.5))]


def test_written_lines_of_a_wide_file(spark, tmp_path):
    p = spark.createDataFrame([(3, 1, 0, [(1.5, 2.0, 0.5), (None, None, None)]), (3, 0, 1, [(1.0, 1.0, 1.0), (2.0, 2.0, 1.0)])], f"video_id bigint, frame bigint, instance int, kps array<{P.POINT}>")
    S.write_poses(p, str(tmp_path / "out"), PROJECT)
    (file,) = (tmp_path / "out" / "video_id=3").glob("part-*")
    assert file.read_text().splitlines() == [
        "scorer," + ",".join(["machine-labeled"] * 12), "individuals," + ",".join(["a"] * 6 + ["b"] * 6), "bodyparts," + ",".join(["nose"] * 3 + ["tail"] * 3) + "," + ",".join(["nose"] * 3 + ["tail"] * 3),
        "coords," + ",".join(["x", "y", "likelihood"] * 4), "0,,,,,,,1.0,1.0,1.0,2.0,2.0,1.0", "1,1.5,2.0,0.5,,,,,,,,,",
    ]


def test_annotation_text_of_odd_lines(spark, tmp_path):
    text = "Some tool\n\nConfiguration file:\nrun\tr\nrest q\nbroken line here\n\nS1:\tstart\tend\ttype\n------\n\t3\t5\trun\n\t5\t6\trun\n\tx\t7\trun\n\t9\t8\trest\n\t8\t8\tjump\n 1 2\n"
    path = write(tmp_path, "a.txt", text)
    rows = T.read_annotation(spark, path)
    assert sorted((r.frame, r.category) for r in rows.collect()) == [(3, "run"), (4, "run"), (5, "run"), (6, "run"), (8, "jump")]
    assert T.read_categories(spark, path) == {"run": ("r", "#B8B8B8"), "rest": ("q", "#00BCD4"), "jump": ("j", "#FF9800")}
    # the block's order, repeated names, data lines of two words, and data before the header
    odd = "Configuration file:\nwalk\tw\neat\te\nwalk\tx\n\n3\t4\tearly\nS1:\tstart\tend\ttype\n5  9\n 1\t2\tsleep\n 3\t4\tdrink\n 9\t1\trear\n"
    path = write(tmp_path, "b.txt", odd)
    assert list(T.read_categories(spark, path).items()) == [("walk", ("x", "#B8B8B8")), ("eat", ("e", "#00BCD4")), ("sleep", ("s", "#FF9800")), ("drink", ("d", "#4CAF50")), ("rear", ("r", "#FFEB3B"))]
    assert sorted((r.frame, r.category) for r in T.read_annotation(spark, path).collect()) == [(1, "sleep"), (2, "sleep"), (3, "drink"), (4, "drink")]


def test_onehot_without_its_first_row(spark, tmp_path):
    csv = write(tmp_path, "a.csv", "time,run,other\n0.1,1,0\n0.2,0,1\n")
    meta = '{"video_id": 0, "used_frames": [4, 5, 6], "total_frames": 8, "behav_map": {"run": ["r", "#fff"], "other": ["o", "#000"]}}\n'
    got = sorted((r.frame, r.category) for r in T.read_onehot(spark, csv, write(tmp_path, "a.json", meta)).collect())
    assert got == sorted([(5, "run")] + [(f, "other") for f in range(8) if f != 5])
    with pytest.raises(ValueError, match="run"):
        T.read_onehot(spark, csv, write(tmp_path, "b.json", meta.replace('"run"', '"walk"')))


def test_projects_and_catalogue(spark, tmp_path):
    one = J.read_project(spark, write(tmp_path, "p.yaml", "scorer: me\nbodyparts:\n- nose\n- tail\nskeleton:\n- [nose, tail]\n"))
    assert one == J.Project(("nose", "tail"), (), "me", False, (("nose", "tail"),)) and one.animals == 1
    cat = J.read_catalogue(spark, write(tmp_path, "c.csv", "20240103 x,A,L\n20240103 y,B,R\n"))
    paths = spark.createDataFrame([("d/20240103 Marathon/0105/A01x_c.w",), ("d\\20240103 Marathon\\B02y_c.w",), ("d/20240103 Marathon/C01x_c.w",), ("elsewhere/A01x_c.w",)], "path string")
    got = {r.path: (r.role, r.day_num, r.name) for r in J.output_names(paths, cat).collect()}
    assert list(got.values()).count((None, 1, None)) == 2
    assert got["d/20240103 Marathon/0105/A01x_c.w"] == ("sub", 3, "0103_sub_day3_A01.csv") and got["d\\20240103 Marathon\\B02y_c.w"] == ("sub", 1, "0103_sub_day1_B02.csv")


def test_smoothing_of_one_score(spark):
    s = spark.createDataFrame([(0, 5, 0.7)], "video_id bigint, frame bigint, v double")
    grid = spark.createDataFrame([(0, f) for f in range(30)], "video_id bigint, frame bigint")
    assert all(abs(r.v - 0.7) < 1e-9 for r in E.smoothed(s, grid, "v").collect())


def test_repeats_and_empty_tables(spark):
    p = table(spark, {(0, 0): np.array([[1.0, 2, 0.5]])}).limit(0)
    none = spark.createDataFrame([], "video_id bigint, frame bigint, instance int")
    total = spark.createDataFrame([], "video_id bigint, total bigint")
    assert M.average_pose(p, none, total, 0, 0, 0).count() == 0
    assert M.complete_frames(spark.createDataFrame([], "video_id bigint, instance int, keypoint int, frame bigint, x double, y double, conf double"), 2).count() == 0
    assert P.interpolated(P.to_long(p)).count() == 0
    assert E.segments(spark.createDataFrame([], "video_id bigint, frame bigint, eligible boolean, safe boolean")).count() == 0


def test_separation_says_when_to_stop(spark):
    rng = np.random.default_rng(8)
    near, far = rng.normal(1, 0.1, 400), rng.normal(9, 0.1, 400)
    clear = spark.createDataFrame([(float(a), float(b)) for a, b in zip(near, far, strict=True)], "d0 double, d1 double")
    got = E.separation(clear)
    margin = np.abs(near - far)
    assert got["stop"] and got["bimodal"] and math.isclose(got["confidence_cv"], margin.mean() / (margin.std() + 1e-6), rel_tol=1e-9)
    assert not E.separation(clear.limit(60))["stop"] and not E.separation(clear.limit(0))["stop"]
    assert not E.separation(clear.withColumn("d1", F.col("d0") + 0.5))["stop"]
