"""Steps that depend on the ones before, against plain Python that walks frame by frame."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from posetrail.operators import identity as I
from posetrail.operators import numbers as N
from posetrail.operators import pose as P
from posetrail.operators import runs as R


def frame(spark, videos, schema):
    return spark.createDataFrame([(v, i, *x) for v, rows in enumerate(videos) for i, x in enumerate(rows)], f"video_id bigint, frame bigint, {schema}")


def cuts(values):
    """[start, end, value] of equal neighbours."""
    out = []
    for i, v in enumerate(values):
        if out and out[-1][2] == v:
            out[-1][1] = i
        else:
            out.append([i, i, v])
    return out


def walked_bouts(labels, least):
    labels = list(labels)
    while True:
        bouts = cuts(labels)
        size = [e - s + 1 for s, e, _ in bouts]
        short = [k for k in range(1, len(bouts) - 1) if size[k] < least]
        if not short:
            return [tuple(b) for b in bouts]
        for k in short:
            s, e, _ = bouts[k]
            labels[s : e + 1] = [labels[s - 1] if size[k - 1] >= size[k + 1] else labels[e + 1]] * (e - s + 1)


def test_short_bouts(spark):
    rng = random.Random(1)
    videos = [[0] * 5 + [1, 2] + [3] * 5, [1, 2, 3], [4], [1, 1, 2, 2]]
    videos += [[v for _ in range(rng.randint(1, 30)) for v in [rng.randint(0, 3)] * rng.choice((1, 1, 2, 3, 6))] for _ in range(25)]
    df = frame(spark, [[(v,) for v in x] for x in videos], "label int")
    for least in (2, 3, 5):
        got: dict = {}
        for r in R.short_bouts(df, "label", least).collect():
            got.setdefault(r["video_id"], []).append((r["start"], r["end"], r["label"]))
        for k, labels in enumerate(videos):
            assert sorted(got[k]) == walked_bouts(labels, least), (labels, least)
    assert R.short_bouts(df.limit(0), "label", 3).count() == 0


def walked_blobs(counts, merged, b):
    n, count, m = len(counts), [min(c, 2) for c in counts], list(merged)
    for s, e, v in cuts(m):
        if s == e:
            m[s] = m[s - 1]
        elif v == 1:
            for f in range(max(0, s - b), min(n, e + b + 1)):
                m[f] = 1
    two = {f for f in range(n) if m[f] == 1}
    for s, e, v in cuts(count):
        if s == e:
            count[s] = count[s - 1]
        elif v == 2:
            two |= set(range(max(0, s - b), min(n, e + b + 1)))
    return [2 if f in two else count[f] for f in range(n)], m


def test_blob_clean(spark):
    rng = random.Random(2)
    videos = [[(1, 0)] * 7 + [(2, 1)] + [(1, 0)] * 9, [(2, 1)], [(3, 1), (1, 0)]]
    for _ in range(40):
        n, sticky = rng.randint(1, 60), rng.choice((0.3, 0.7, 0.95))
        rows, now = [], (1, 0)
        for _ in range(n):
            if rng.random() > sticky:
                now = (rng.randint(0, 3), rng.randint(0, 1))
            rows.append(now)
        videos.append(rows)
    df = frame(spark, videos, "animal_count int, merged int")
    for b in (2, 5):
        got: dict = {}
        for r in R.blob_clean(df, b).orderBy("frame").collect():
            got.setdefault(r.video_id, []).append((r.animal_count, r.merged))
        for k, rows in enumerate(videos):
            count, m = walked_blobs([x[0] for x in rows], [x[1] for x in rows], b)
            assert got[k] == list(zip(count, m, strict=True)), (rows, b)


def test_kalman(spark):
    rng = np.random.default_rng(3)
    tracks = [np.array([[0.0, 5], [1, 5], [2, 5], [3, 5]]), rng.normal(size=(300, 2)).cumsum(axis=0)]
    rows = [(0, k, i, float(x), float(y)) for k, t in enumerate(tracks) for i, (x, y) in enumerate(t)]
    df = spark.createDataFrame(rows, "video_id bigint, instance int, frame bigint, x double, y double")
    got = {(r.instance, r.frame): (r.x, r.y) for r in R.kalman(df).collect()}
    a, h = np.eye(4) + np.eye(4, k=2), np.eye(2, 4)
    q = 0.8 * np.array([[0.25, 0, 0.5, 0], [0, 0.25, 0, 0.5], [0.5, 0, 1, 0], [0, 0.5, 0, 1]])
    for k, t in enumerate(tracks):
        s, c = np.array([*t[0], 0, 0]), 50 * np.eye(4)
        for i, z in enumerate(t):
            s, c = a @ s, a @ c @ a.T + q
            g = c @ h.T @ np.linalg.inv(h @ c @ h.T + 0.7 * np.eye(2))
            s, c = s + g @ (z - h @ s), (np.eye(4) - g @ h) @ c
            assert np.allclose(got[k, i], s[:2], atol=1e-9)
    assert math.isclose(got[0, 1][0], 0.97493, abs_tol=1e-5) and math.isclose(got[0, 3][0], 2.99523, abs_tol=1e-5)


def walked_sweep(frames, length, singles=None, locked=0):
    """frames: {frame: {instance: (x, y)}}; singles: {frame: (single, single before, blobs)}."""
    place, seen, checked, out = {}, {}, 0, {}
    for f in sorted(frames):
        obs = dict(frames[f])
        for i in list(place):
            if f - seen[i] > 10:
                del place[i]
        single, before, blobs = (singles or {}).get(f, (False, False, None))
        swap = doubt = False
        since, stop = None, False
        d = math.dist
        if place and len(obs) == 1:
            (i, p), = obs.items()
            if len(place) == 1:
                (r, at), = place.items()
                if single:
                    swap, checked = i != locked, f
                elif d(at, p) > 1.2 * length:
                    doubt = stop = True
                else:
                    swap = i != r
            elif single and before:
                swap, checked = i != locked, f
            else:
                c0, c1 = d(place[i], p), d(place[1 - i], p)
                if min(c0, c1) > 1.2 * length or singles is not None and blobs > 1 and c0 + c1 < length:
                    doubt = stop = True
                else:
                    doubt, swap = abs(c0 - c1) < 0.15 * (c0 + c1), c0 > c1
                    if single:
                        if (1 - i if swap else i) != locked and f > checked + 1:
                            swap, doubt, since = not swap, True, checked + 1
                        checked = f
        elif place:
            refs = sorted(place)
            c0, c1 = sum(d(place[r], obs[r]) for r in refs), sum(d(place[r], obs[1 - r]) for r in refs)
            if min(c0, c1) > 1.2 * length * (1.5 if len(refs) == 2 else 1):
                doubt = stop = True
            else:
                doubt, swap = abs(c0 - c1) < 0.15 * (c0 + c1), c0 > c1
        out[f] = (False, True, None) if stop else (swap, doubt, since)
        if not stop:
            for i, p in obs.items():
                k = 1 - i if swap else i
                place[k], seen[k] = p, f
    return out


def test_motion_sweep(spark):
    rng = random.Random(4)
    videos = [{0: {0: (0.0, 0.0), 1: (9.0, 0.0)}, 1: {0: (500.0, 0.0)}, 2: {1: (1.0, 0.0)}}]
    for _ in range(12):
        rows, at, f = {}, [[0.0, 0.0], [30.0, 0.0]], 0
        for _ in range(150):
            f += rng.choice((1, 1, 1, 1, 2, 5, 14))
            for p in at:
                p[0] += rng.gauss(0, 6)
                p[1] += rng.gauss(0, 6)
            flip = rng.random() < 0.2
            rows[f] = {(1 - i if flip else i): (at[i][0] + 200 * (rng.random() < 0.03), at[i][1]) for i in (0, 1) if rng.random() < 0.75} or {0: tuple(at[0])}
        videos.append(rows)
    rows = [(v, f, i, *p) for v, frames in enumerate(videos) for f, obs in frames.items() for i, p in obs.items()]
    centres = spark.createDataFrame(rows, "video_id bigint, frame bigint, instance int, cx double, cy double")
    size = spark.createDataFrame([(v, 20.0) for v in range(len(videos))], "video_id bigint, body_length double")
    got = {(r.video_id, r.frame): (r.swap, r.ambiguous, r.locked_from) for r in I.motion_sweep(centres, size).collect()}
    want = {(v, f): x for v, frames in enumerate(videos) for f, x in walked_sweep(frames, 20.0).items()}
    assert got == want and any(x[0] for x in got.values()) and any(x[1] for x in got.values())
    # with the id lock
    counts = [(v, f, rng.choice((0, 1, 1, 2)) if f % 40 < 15 else 1) for v, frames in enumerate(videos) for f in range(max(frames) + 1)]
    blobs = spark.createDataFrame(counts, "video_id bigint, frame bigint, animal_count int")
    singles = I.single_frames(blobs, centres)
    told, locks = {}, {}
    for v, frames in enumerate(videos):
        of = {f: c for w, f, c in counts if w == v}
        one = [of[f] <= 1 and len(frames.get(f, {})) <= 1 for f in range(max(frames) + 1)]
        for s, e, x in cuts(one):
            if x and e - s + 1 < 5:
                one[s : e + 1] = [False] * (e - s + 1)
        told[v] = {f: (one[f], f > 0 and one[f - 1], of[f]) for f in of}
        first = [f for f in sorted(of) if of[f] <= 1 and len(frames.get(f, {})) == 1][:10]
        locks[v] = 0 if sum(0 in frames[f] for f in first) >= 5 else 1
    for r in singles.collect():
        assert (r.single, r.single_before, r.blobs) == told[r.video_id][r.frame] and r.locked == locks[r.video_id]
    got = {(r.video_id, r.frame): (r.swap, r.ambiguous, r.locked_from) for r in I.motion_sweep(centres, size, singles).collect()}
    want = {(v, f): x for v, frames in enumerate(videos) for f, x in walked_sweep(frames, 20.0, told[v], locks[v]).items()}
    assert got == want and any(x[2] is not None for x in got.values())


def test_two_clusters(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.1, (30, 4)), rng.normal(3, 0.1, (20, 4))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r for r in I.two_clusters(df).collect()}
    assert [got[i].cluster for i in range(50)] == [0] * 30 + [1] * 20
    centres = [x[:30].mean(axis=0), x[30:].mean(axis=0)]
    margin = np.abs(np.linalg.norm(x - centres[0], axis=1) - np.linalg.norm(x - centres[1], axis=1))
    p75 = np.percentile(margin, 75)
    assert np.allclose([got[i].confidence for i in range(50)], 1 / (1 + np.exp(-(margin - p75) / (0.5 * p75))), atol=1e-9)


@pytest.mark.parametrize("values", [[3.0], [1.0, 1.0, 1.0], list(range(10_000)), [0.0] * 5000 + [1e-9] * 5000 + [7.5], [-5.0, 1e12, 3.0, None]])
def test_quantiles(spark, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    some = [v for v in values if v is not None]
    assert np.allclose(N.quantiles(df, "v", (0.0, 0.3, 0.5, 0.99, 1.0)), np.percentile(some, [0, 30, 50, 99, 100]), rtol=1e-12)
    assert N.quantiles(df.limit(0), "v", (0.5,)) == [None]


def test_whole_gaps_over_the_limit_are_null_again(spark):
    rows = [(0, 0, k, f, float(10 * k + f), 1.0, 0.5) for k in (0, 1) for f in (0, 1, 3, 9, 10) if (k, f) != (1, 3)]
    long = spark.createDataFrame(rows, "video_id bigint, instance int, keypoint int, frame bigint, x double, y double, conf double")
    got = {(r.keypoint, r.frame): r.x for r in P.interpolated(long, 3).collect()}
    assert len(got) == 22 and got[1, 3] == 13.0 and got[0, 2] == 2.0  # frame 3 holds keypoint 0, so it is no gap of the track
    assert all(got[k, f] is None for k in (0, 1) for f in range(4, 9))
    assert all(r.x is not None for r in P.interpolated(long).collect())


def test_velocity_needs_two_frames_and_averages_keypoints(spark):
    rows = [(0, 0, f, k, float(f * (k + 1)), 0.0, 0.0, 0.9) for f in range(4) for k in (0, 1) if (f, k) != (0, 1)]
    t = spark.createDataFrame(rows, "video_id bigint, instance int, frame bigint, keypoint int, x double, y double, z double, conf double")
    got = {r.frame: r.speed for r in I.velocity3d(t, ["video_id", "instance"]).collect()}
    assert set(got) == {1, 2, 3} and np.allclose([got[1], got[2], got[3]], [1.0, 1.5, 1.5])


def test_scalars(spark):
    df = spark.createDataFrame([(2.5, 3.0, 4.0), (-2.5, 0.0, 0.0), (None, None, None)], "v double, x double, y double")
    distance, angle, degrees, radians = N.polar(F.col("x"), F.col("y"))
    got = df.select(N.round_half_up(F.col("v")), N.clipped(F.col("v"), -1, 1), N.sigmoid(F.col("v")), distance, degrees).collect()
    assert got[0][:2] == (3, 1.0) and got[1][:2] == (-2, -1.0) and got[2][0] is None and got[2][1] is None
    assert math.isclose(got[0][2], 1 / (1 + math.exp(-2.5))) and got[0][3] == 5.0 and math.isclose(got[0][4], math.degrees(math.atan2(4, 3)))


def test_kalman_over_blocks(spark, monkeypatch):
    """One track over many blocks of steps and of frames, with absent frames, against the filter step by step."""
    monkeypatch.setattr(R, "BLOCK", 128)
    monkeypatch.setattr(R, "STEPS", 50)
    rng = np.random.default_rng(11)
    tracks = {0: 1234, 1: 50, 2: 51, 3: 1}
    rows = [(0, f, i, float(x), float(y)) for i, n in tracks.items() for f, (x, y) in enumerate(np.cumsum(rng.normal(0, 5, (n, 2)), axis=0)) if f == 0 or rng.random() < 0.8]
    df = spark.createDataFrame(rows + [(0, 2000, 0, None, 1.0)], "video_id bigint, frame bigint, instance int, x double, y double")
    got = {(r.instance, r.frame): (r.x, r.y) for r in R.kalman(df.repartition(3)).collect()}
    assert len(got) == len(rows)
    for i in tracks:
        own = [(f, x, y) for _, f, j, x, y in rows if j == i]
        for axis in (1, 2):
            state, cov = np.array([own[0][axis], 0.0]), np.eye(2) * 50
            move, noise = np.array([[1, 1], [0, 1.0]]), 0.8 * np.array([[0.25, 0.5], [0.5, 1]])
            for row in own:
                state, cov = move @ state, move @ cov @ move.T + noise
                gain = cov[:, 0] / (cov[0, 0] + 0.7)
                state, cov = state + gain * (row[axis] - state[0]), cov - np.outer(gain, cov[0])
                assert math.isclose(got[i, row[0]][axis - 1], state[0], rel_tol=1e-9, abs_tol=1e-9)
