"""Binary frames: kernels against plain numpy and pixel by pixel, backgrounds, masks, blobs by flood fill, and cutouts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from posetrail.operators import frames as G
from posetrail.operators import runs as R

PIXEL = "video_id bigint, frame bigint, x int, y int, b int, g int, r int"


def images(spark, arrays, video=0):
    rows = [(video, f, *a.shape[:2], a.shape[2] if a.ndim == 3 else 1, a.astype(np.uint8).tobytes()) for f, a in arrays]
    return spark.createDataFrame(rows, "video_id bigint, frame bigint, h int, w int, c int, data binary")


def arrays(df):
    return {r.frame: np.frombuffer(r.data, dtype=np.uint8).reshape(r.h, r.w, r.c) for r in df.collect()}


@pytest.fixture(scope="module")
def film():
    rng = np.random.default_rng(1)
    return [(f, rng.integers(0, 256, (7, 9, 3))) for f in range(12)]


def test_packing_and_unpacking(spark, film):
    rows = [(0, f, x, y, *map(int, a[y, x])) for f, a in film for y in range(7) for x in range(9)]
    df = spark.createDataFrame(rows, PIXEL)
    made = G.packed(df.repartition(4))
    assert {f: a.tolist() for f, a in arrays(made).items()} == {f: a.tolist() for f, a in film}
    assert sorted(map(tuple, G.unpacked(made).collect())) == sorted(rows)
    assert G.gray(made.limit(0)).count() == 0


def test_batches_of_bounded_bytes(spark, film, monkeypatch):
    monkeypatch.setattr(G, "BATCH_BYTES", 100)
    assert len(arrays(G.gray(images(spark, film)))) == 12


def test_gray_and_paint(spark, film):
    gray = lambda a: (114 * a[..., 0] + 587 * a[..., 1] + 299 * a[..., 2] + 500) // 1000
    got = arrays(G.gray(images(spark, film)))
    assert all((got[f][:, :, 0] == gray(a)).all() for f, a in film)
    marks = np.zeros((7, 9), dtype=np.uint8)
    marks[2, 3], marks[4, 5] = 1, 2
    paint = spark.createDataFrame([(0, marks.tobytes())], "video_id bigint, data binary")
    both = images(spark, film).union(images(spark, [(99, film[0][1])], video=1))  # video 1 has no paint
    for f, a in arrays(G.augmented(both, paint, (2, 1, 8, 6))).items():
        want = gray(film[0][1] if f == 99 else film[f][1]).copy()
        if f != 99:
            want[2, 3], want[4, 5] = 0, 255
        assert (a[:, :, 0] == want[1:6, 2:8]).all()
    assert arrays(G.augmented(both, paint, (0, 0, 9, 7), to_gray=False))[0].shape == (7, 9, 3)


def test_lab_of_known_colours(spark):
    known = images(spark, [(0, np.array([[(255, 255, 255), (0, 0, 0), (0, 0, 255), (255, 0, 0), (128, 128, 128)]]))])
    assert arrays(G.toned(known))[0][0].tolist() == [[255, 128, 128], [0, 128, 128], [136, 208, 195], [82, 207, 20], [137, 128, 128]]
    assert arrays(G.toned(known, 0.5, 10.0, (5, -130, 200)))[0][0][0].tolist() == [min(255, int(G.lab_of(np.full((1, 1, 3), 138))[0, 0, 0]) + 5), 0, 255]


def test_backgrounds_and_masks(spark):
    film = [(f, np.array([[[f] * 3, [200] * 3]])) for f in range(200)]
    px = images(spark, film)
    near = [int(v) for v in np.linspace(0, 199, 100)]
    for tile in (1, 4, 1000):
        b = G.background(px, tile=tile).first()
        first = {s: np.frombuffer(b[s], dtype=np.uint8).reshape(1, 2, 3) for s in G.STATISTICS}
        assert (first["mean"][0, 0, 0], first["median"][0, 0, 1], first["p5"][0, 0, 2]) == (int(np.mean(near)), int(np.median(near)), int(np.percentile(near, 5)))
        assert first["least"][0, 1, 0] == first["most"][0, 1, 1] == first["p95"][0, 1, 2] == 200
    ground = spark.createDataFrame([(0, 1, 2, 3, bytes([60] * 3 + [200] * 3))], "video_id bigint, h int, w int, c int, data binary")
    moved = [v for v in range(200) if abs(v - 60) >= 25]
    want = [60 <= 1.3 * np.percentile(moved, 20), 200 <= 1.3 * np.percentile(moved, 20)]
    assert [list(map(bool, r.data)) for r in G.smart_mask(px, ground).collect()] == [want]
    light = [60 >= 0.7 * np.percentile(moved, 80), 200 >= 0.7 * np.percentile(moved, 80)]
    assert [list(map(bool, r.data)) for r in G.smart_mask(px, ground, dark=False).collect()] == [light]
    assert G.smart_mask(px, ground, least=500).count() == 0


def test_tones(spark):
    px = images(spark, [(f, np.full((3, 4, 3), 200)) for f in range(4)])
    flat = G.tones(px, lab=False).where("frame = 0").first()
    assert sorted(flat.tone) == [0.0] * 7 + [1.0]
    assert abs(G.tone_distance(G.tones(px), px.select("video_id", "frame")).first().distance) < 1e-6
    areas = spark.createDataFrame([(0, 0, 5.0), (0, 0, 50.0), (0, 1, 5.0)], "video_id bigint, frame bigint, area double")
    assert sorted(tuple(r) for r in G.blob_counts(areas, 50.0).collect()) == [(0, 0, 3, 1), (0, 1, 1, 0)]


def draw(cells):
    a = np.full((10, 14), 200)
    for x, y in cells:
        a[y, x] = 10
    return a


def test_blob_areas_by_the_polygon(spark):
    """Rectangles, a ring with a blob inside of it, a diagonal and single pixels: areas of the polygons through their border pixels."""
    ring = {(x, y) for x in range(3, 9) for y in range(2, 8)} - {(x, y) for x in range(5, 7) for y in range(4, 6)}
    wide = {(x, y) for x in range(1, 10) for y in range(1, 9)} - {(x, y) for x in range(2, 9) for y in range(2, 8)}
    frames = {
        0: {(x, y) for x in range(1, 5) for y in range(1, 4)}, 1: ring, 2: {(k, k) for k in range(6)} | {(9, 9)}, 3: {(2, 2), (3, 2), (2, 3)},
        4: {(0, y) for y in range(3)} | {(x, y) for x in (5, 6) for y in (5, 6)}, 5: set(), 6: wide | {(x, y) for x in (4, 5) for y in (4, 5)},
    }
    px = images(spark, [(f, draw(c)) for f, c in frames.items()])
    got: dict = {}
    for r in G.blob_areas(px, threshold=100, least=0.0).collect():
        got.setdefault(r.frame, []).append(r.area)
    assert got == {0: [6.0], 1: [25.0], 3: [0.5], 4: [1.0], 6: [56.0]}
    ground = spark.createDataFrame([(0, bytes([200] * 140))], "video_id bigint, data binary")
    assert {(r.frame, r.area) for r in G.blob_areas(px, ground, 25, 0.0).collect()} == {(f, a) for f, v in got.items() for a in v}
    assert G.blob_areas(px, ground, 25, 0.0, dark=False).count() == 0
    inside = {(r.frame, r.area) for r in G.blob_areas(px, threshold=100, least=0.0, roi=(3, 0, 14, 10)).collect() if r.frame < 6}
    assert inside == {(0, 2.0), (1, 25.0), (4, 1.0)}


def test_components_against_flood_fill():
    rng = np.random.default_rng(2)
    for k in range(300):
        on = rng.random((rng.integers(1, 14), rng.integers(1, 17))) < rng.choice([0.2, 0.5, 0.8])
        for corners in (False, True):
            label, n = G.components(on, corners)
            want, at = np.full(on.shape, -1), 0
            for y, x in zip(*np.nonzero(on), strict=True):
                if want[y, x] < 0:
                    todo = [(y, x)]
                    while todo:
                        i, j = todo.pop()
                        if 0 <= i < on.shape[0] and 0 <= j < on.shape[1] and on[i, j] and want[i, j] < 0:
                            want[i, j] = at
                            todo += [(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (corners or not (a and b)) and (a or b)]
                    at += 1
            assert n == at and (label == want).all(), (k, corners)


def test_areas_against_a_border_walk():
    """The area of the polygon that a walk around each outermost blob describes (squares, then Moore neighbours)."""
    rng = np.random.default_rng(3)
    ring = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]  # clockwise, rows grow downwards
    for _ in range(200):
        on = np.pad(rng.random((9, 11)) < rng.choice([0.3, 0.6, 0.9]), 1)
        free, _ = G.components(~on, False)
        filled = free != 0
        label, n = G.components(filled, True)
        want = []
        for k in range(n):
            blob = label == k
            start = tuple(int(v[0]) for v in np.nonzero(blob))
            path, at, back, first = [start], start, 4, None
            while True:
                for turn in range(1, 9):
                    d = (back + turn) % 8
                    to = (at[0] + ring[d][0], at[1] + ring[d][1])
                    if blob[to]:
                        break
                else:
                    break
                if first is None:
                    first = (at, to)
                elif (at, to) == first:
                    break
                path.append(to)
                at, back = to, (d + 4) % 8
            y, x = np.array(path).T
            want.append(abs(np.sum(x * np.roll(y, -1) - y * np.roll(x, -1))) / 2)
        assert np.allclose(sorted(G.areas_of(on[1:-1, 1:-1])), sorted(want))


def test_cutouts_against_loops(spark, film):
    rng = np.random.default_rng(4)
    crops = [(0, f, i, float(rng.uniform(-2, 10)), float(rng.uniform(-2, 8)), float(rng.choice([0, 90, 37.5, -120]))) for f in range(11) for i in range(f % 3)]
    df = spark.createDataFrame(crops, "video_id bigint, frame bigint, instance int, cx double, cy double, angle double")
    got = {(r.frame, r.instance): np.frombuffer(r.data, dtype=np.uint8).reshape(r.h, r.w, r.c) for r in G.cutouts(images(spark, film), df, 5).collect()}
    assert len(got) == len(crops)
    for _, f, i, cx, cy, angle in crops:
        a, t = film[f][1], math.radians(angle)
        for v in range(5):
            for u in range(5):
                x, y = cx + (u - 2.5) * math.cos(t) - (v - 2.5) * math.sin(t), cy + (u - 2.5) * math.sin(t) + (v - 2.5) * math.cos(t)
                total = np.zeros(3)
                for px, py in ((math.floor(x) + p, math.floor(y) + q) for p in (0, 1) for q in (0, 1)):
                    if 0 <= px < 9 and 0 <= py < 7:
                        total += (1 - abs(x - px)) * (1 - abs(y - py)) * a[py, px]
                assert (got[f, i][v, u] == np.floor(np.round(total, 6) + 0.5)).all()


def test_kernels_see_stacks(spark, film):
    """Images of a batch reach a kernel together, sizes and absent data apart, and large ones alone."""
    other = images(spark, [(f, np.zeros((2, 2, 3))) for f in range(100, 105)])
    none = other.limit(1).withColumns({"frame": F.lit(200).cast("bigint"), "data": F.lit(None).cast("binary")})
    seen = G.kernel(images(spark, film).union(other).union(none).coalesce(1), lambda a: [(None, np.int32(len(a)))], "n int").collect()
    assert sorted((r.frame, r.n) for r in seen) == [(f, 12) for f in range(12)] + [(f, 5) for f in range(100, 105)]


def test_areas_of_many_images_at_once():
    rng = np.random.default_rng(5)
    on = rng.random((40, 6, 8)) < rng.choice([0.3, 0.6, 0.9], (40, 1, 1))
    image, blob, area = G.areas_in(on)
    for k in range(40):
        assert area[image == k].tolist() == G.areas_of(on[k]).tolist() and blob[image == k].tolist() == list(range((image == k).sum()))


def test_even_frames_by_their_ranks(spark):
    for n, k in ((1, 1), (5, 1), (7, 3), (100, 100), (101, 100), (250, 100), (1000, 7)):
        f = spark.range(n).select(F.lit(0).alias("video_id"), (F.col("id") * 3).alias("frame"))
        want = range(n) if n <= k else {i * (n - 1) // max(k - 1, 1) for i in range(k)}
        assert sorted(r.frame for r in R.evenly(f, k).collect()) == sorted(3 * i for i in want)
