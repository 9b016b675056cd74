"""Repair of identities and tracks, samples of re-inference, and multi-camera geometry."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posetrail.operators import numbers as N
from posetrail.operators import pose as P
from posetrail.operators import runs as R
from posetrail.operators.lineage import cut


def fill_missing(pose: DataFrame, canon: DataFrame, least: int = 3) -> DataFrame:
    """Keypoints of the video's canonical pose, rigidly fitted to the visible ones (``least`` at least), fill what is absent, conf 1.

    canon has one row per video and keypoint; the fit is closed: the angle is atan2(sum of cross products, sum of dot products).
    """
    c = canon.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("keypoint", "cx", "cy"))).alias("canon"))
    j = P.once(pose.join(c, "video_id"), both=F.filter(F.arrays_zip("kps", "canon"), lambda b: P.seen(b["kps"])))
    n = F.size("both")
    total = lambda f: F.aggregate(F.transform("both", f), F.lit(0.0), lambda s, v: s + v)
    mean = lambda f: total(f) / F.nullif(n, F.lit(0))
    j = P.once(j, ox=mean(lambda b: b["kps"]["x"]), oy=mean(lambda b: b["kps"]["y"]), mx=mean(lambda b: b["canon"]["cx"]), my=mean(lambda b: b["canon"]["cy"]))
    cx, cy = (lambda b: b["canon"]["cx"] - F.col("mx")), (lambda b: b["canon"]["cy"] - F.col("my"))
    ox, oy = (lambda b: b["kps"]["x"] - F.col("ox")), (lambda b: b["kps"]["y"] - F.col("oy"))
    j = P.once(j, by=F.atan2(total(lambda b: cx(b) * oy(b) - cy(b) * ox(b)), total(lambda b: cx(b) * ox(b) + cy(b) * oy(b))))

    def put(p: Column, k: Column) -> Column:
        dx, dy = k["cx"] - F.col("mx"), k["cy"] - F.col("my")
        x, y = F.col("ox") + dx * F.cos("by") - dy * F.sin("by"), F.col("oy") + dx * F.sin("by") + dy * F.cos("by")
        return F.when(P.seen(p), p).otherwise(F.struct(x.alias("x"), y.alias("y"), F.lit(1.0).alias("conf")))

    filled = F.when(n >= least, F.zip_with("kps", "canon", put)).otherwise(F.col("kps"))
    return j.select(*P.KEYS, filled.alias("kps"))


def swap_orders(pose: DataFrame, orders: DataFrame) -> DataFrame:
    """Ordered decisions (video_id, frame, kind): 'i' swaps one frame, 't' from it to the end; the parity of all that apply decides."""
    o = orders.groupBy("video_id", "frame").agg(F.sum((F.col("kind") == "i").cast("int")).alias("i"), F.sum((F.col("kind") == "t").cast("int")).alias("t"))
    frames = pose.select("video_id", "frame").distinct().join(o, ["video_id", "frame"], "full")
    parity = (F.sum(F.coalesce("t", F.lit(0))).over(R.video()) + F.coalesce("i", F.lit(0))) % 2
    flags = frames.select("video_id", "frame", parity.alias("swap"))
    return pose.join(flags, ["video_id", "frame"]).withColumn("instance", F.when(F.col("swap") == 1, 1 - F.col("instance")).otherwise(F.col("instance"))).drop("swap")


def greedy_match(old: DataFrame, new: DataFrame) -> DataFrame:
    """(video_id, frame, swap) of (video_id, frame, instance, cx, cy): swap if the crossed distances sum to less; a missing one counts 1e6."""
    wide = lambda t, n: t.groupBy("video_id", "frame").agg(*(F.max(F.when(F.col("instance") == i, F.col(c))).alias(f"{n}{i}{c}") for i in (0, 1) for c in ("cx", "cy")))
    j = wide(old, "o").join(wide(new, "n"), ["video_id", "frame"])
    dist = lambda a, b: F.coalesce(F.hypot(F.col(f"o{a}cx") - F.col(f"n{b}cx"), F.col(f"o{a}cy") - F.col(f"n{b}cy")), F.lit(1e6))
    return j.select("video_id", "frame", (dist(0, 1) + dist(1, 0) < dist(0, 0) + dist(1, 1)).alias("swap"))


def merge_predictions(old: DataFrame, new: DataFrame, frames: DataFrame) -> DataFrame:
    """New rows replace old ones on the listed frames."""
    key = ["video_id", "frame"]
    return old.join(frames, key, "left_anti").unionByName(new.join(frames, key, "left_semi"))


def keep_newest(files: DataFrame, n: int) -> DataFrame:
    """Column keep: among the n newest files of their group."""
    w = Window.partitionBy("video", "params").orderBy(F.desc("mtime"), F.desc("path"))
    return files.withColumn("keep", F.row_number().over(w) <= n)


#: Cameras whose matrices may travel with the tasks.
CAMERAS = 10_000
SWEEP_SILENCE = 10


def prepared(pose: DataFrame, head: int, center: int, tail: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pose, centres, lengths) for the sweep: without duplicates and poses of one keypoint; anatomical centres (keys, cx, cy); body lengths."""
    clean = pose.where(P.visible() > 1).join(P.out_duplicate(pose), P.KEYS, "left_anti")
    return clean, anatomical_center(clean, head, center, tail).select(*P.KEYS, "cx", "cy"), P.body_length(clean, head, tail)


def single_frames(counts: DataFrame, poses: DataFrame, least: int = 5) -> DataFrame:
    """(video_id, frame, single, single_before, blobs, locked) for the id lock of ``motion_sweep``.

    counts: (video_id, frame, animal_count) of every frame; poses: (video_id, frame, instance) of present animals. A frame is single
    where both count one animal at most, in runs of ``least`` frames or more. The locked id is that of most of the first ten frames
    with one pose and one animal at most; the other one where under five of them show id 0.
    """
    of = poses.groupBy("video_id", "frame").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("instance") == 0).cast("int")).alias("zero"))
    f = counts.join(of, ["video_id", "frame"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    f = f.withColumn("one", (F.col("animal_count") <= 1) & (F.col("n") <= 1))
    r = R.runs(f, "one").where(F.col("one") & (F.col("length") >= least)).select("video_id", F.explode(F.sequence("start", "end")).alias("frame"), F.lit(True).alias("single"))
    first = f.where("animal_count <= 1 and n = 1").withColumn("k", F.row_number().over(R.video())).where("k <= 10")
    locked = first.groupBy("video_id").agg(F.when(F.sum("zero") >= 5, 0).otherwise(1).alias("locked"))
    out = f.join(r, ["video_id", "frame"], "left").join(locked, "video_id", "left")
    out = out.select("video_id", "frame", F.coalesce("single", F.lit(False)).alias("single"), F.col("animal_count").alias("blobs"), F.coalesce("locked", F.lit(1)).alias("locked"))
    return out.withColumn("single_before", F.coalesce(F.lag("single").over(R.video()), F.lit(False)))


def motion_sweep(centres: DataFrame, lengths: DataFrame, singles: DataFrame | None = None, swap_gap: float = 0.15, far: float = 1.2) -> DataFrame:
    """Frame by frame assignment of two animals by their last places: (video_id, frame, swap, ambiguous, locked_from).

    centres: (video_id, frame, instance, cx, cy) of present animals; lengths: (video_id, body_length). A place is forgotten after ten
    frames. A cost over ``far`` lengths (1.5 times that for two animals against two places) makes a frame ambiguous and leaves ids and
    places as they were; a cost gap under ``swap_gap`` of the sum makes it ambiguous as well; the cheaper assignment is taken.
    With ``singles`` (see ``single_frames``) ids are locked: single frames force the locked id, and where a sweep comes back to it with
    the other, the frames from locked_from to before the frame are a stable swap. Without it, a video is cut where ten frames are
    silent, as no place survives them, and its pieces are swept apart. Rows stream through a task with the state of one piece.
    """
    wide = [F.max(F.when(F.col("instance") == i, F.col(c))).alias(f"{c}{i}") for i in (0, 1) for c in ("cx", "cy")]
    f = centres.groupBy("video_id", "frame").agg(*wide).join(lengths, "video_id")
    lock = singles is not None
    if lock:
        f = f.join(singles, ["video_id", "frame"], "left").withColumn("piece", F.lit(0).cast("bigint"))
    else:
        silent = F.coalesce((F.col("frame") - F.lag("frame").over(R.video()) > SWEEP_SILENCE).cast("int"), F.lit(0))
        f = f.withColumn("piece", F.sum(silent).over(R.video()).cast("bigint"))
    columns = ["cx0", "cy0", "cx1", "cy1", "body_length", *(["single", "single_before", "blobs", "locked"] if lock else [])]

    def make():
        place, seen, checked = [None, None], [0, 0], [0]

        def step(frame, x0, y0, x1, y1, length, single=False, before=False, blobs=None, locked=0):
            now = {i: p for i, p in ((0, (x0, y0)), (1, (x1, y1))) if p[0] is not None}
            for i in (0, 1):
                if place[i] is not None and frame - seen[i] > SWEEP_SILENCE:
                    place[i] = None
            # keeping or crossing pairs places with animals; what is missing costs nothing, and a choice without a pair is none
            paths = {s: [math.dist(place[k], now[k ^ s]) for k in (0, 1) if place[k] is not None and k ^ s in now] for s in (0, 1)}
            costs = {s: sum(d) for s, d in paths.items() if d}
            alone = min(now) if len(now) == 1 else None
            sure = lock and single and alone is not None and bool(costs)
            swap, doubt, since, total = 0, False, None, sum(costs.values())
            if sure and (before or len(costs) == 1):
                swap, checked[0] = int(alone != locked), frame
            elif costs:
                swap = min(costs, key=costs.get)
                bar = far * (length if length is not None else math.inf) * (1.5 if len(paths[0]) == len(paths[1]) == 2 else 1)
                merged = lock and alone is not None and len(costs) == 2 and (blobs or 0) > 1 and total < (length or 0)
                if costs[swap] > bar or merged:
                    return False, True, None
                doubt = len(costs) == 2 and abs(costs[0] - costs[1]) < swap_gap * total
                if sure:  # the lock overrules a sweep that comes back with the other id
                    if alone ^ swap != locked and frame > checked[0] + 1:
                        swap, doubt, since = 1 - swap, True, checked[0] + 1
                    checked[0] = frame
            for i, p in now.items():
                place[i ^ swap], seen[i ^ swap] = p, frame
            return bool(swap), doubt, since

        return step

    out = R.streamed(f, ["video_id", "piece"], "frame", columns, make, "video_id bigint, piece bigint, frame bigint, swap boolean, ambiguous boolean, locked_from bigint")
    return out.drop("piece")


def _centres(rows: DataFrame, seed: int) -> tuple[Column, Column]:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    found = KMeans(k=2, seed=seed).fit(rows.withColumn("features", array_to_vector("embedding"))).clusterCenters()
    dist = lambda c: F.sqrt(F.aggregate(F.zip_with("embedding", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    a, b = (dist(F.array(*map(F.lit, map(float, c)))) for c in found)
    return a, b


def centre_distances(rows: DataFrame, seed: int = 7) -> DataFrame:
    """(d0, d1) of every embedding to the two centres."""
    a, b = _centres(rows, seed)
    return rows.select(a.alias("d0"), b.alias("d1"))


def two_clusters(rows: DataFrame, key: str = "vec_id", seed: int = 7) -> DataFrame:
    """(key, cluster, confidence) of embeddings by two-means; cluster 0 holds the smallest key. The margin is the gap of the distances to the
    centres, the confidence sigmoid((margin - p75) / (0.5 p75)), p75 being the exact 75th percentile of the margins (where 0: a half)."""
    a, b = _centres(rows, seed)
    m = rows.select(key, a.alias("d0"), b.alias("d1"))
    m = cut(m.select(key, (F.col("d1") < F.col("d0")).cast("int").alias("cluster"), F.abs(F.col("d0") - F.col("d1")).alias("margin")))
    zero = (m.agg(F.min_by("cluster", key)).first() or [0])[0]
    (p75,) = N.quantiles(m, "margin", (0.75,))
    confidence = N.sigmoid((F.col("margin") - p75) / (0.5 * p75)) if p75 else F.lit(0.5)
    return m.select(key, F.abs(F.col("cluster") - F.lit(zero)).alias("cluster"), confidence.alias("confidence"))


def swap_candidates(classes: DataFrame) -> DataFrame:
    """Spans of class 1 from (video_id, frame, class): inner runs of class 0 take the value of both sides, or 1 if either is 1; runs under 3 go."""
    r = R.runs(classes, "class").withColumn("a", F.lag("class").over(Window.partitionBy("video_id").orderBy("start"))).withColumn("b", F.lead("class").over(Window.partitionBy("video_id").orderBy("start")))
    filled = F.when((F.col("class") == 0) & F.col("a").isNotNull() & F.col("b").isNotNull(), F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.lit(1))).otherwise(F.col("class"))
    frames = r.select("video_id", "start", F.explode(F.sequence("start", "end")).alias("frame"), filled.alias("class")).drop("start")
    return R.runs(frames, "class").where("class = 1 and length >= 3").select("video_id", "start", "end")


# --- several cameras ---

def project(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """points (.., x, y, z) seen by every camera (cam, p array of 12): u, v. Cameras are few, which is checked, and broadcast."""
    if not N.small(cameras, CAMERAS):
        raise ValueError(f"more than {CAMERAS} cameras")
    j = points.crossJoin(F.broadcast(cameras))
    row = lambda i: F.col("p")[4 * i] * F.col("x") + F.col("p")[4 * i + 1] * F.col("y") + F.col("p")[4 * i + 2] * F.col("z") + F.col("p")[4 * i + 3]
    return j.withColumn("u", row(0) / row(2)).withColumn("v", row(1) / row(2)).drop("x", "y", "z")


def triangulate(views: DataFrame, cameras: DataFrame, keys: list[str], least: int = 2, cameras_of: str = "cam") -> DataFrame:
    """(keys, x, y, z, confidence) of views (keys, cam, u, v, conf) by confidence-weighted direct linear transform; null where the last
    coordinate vanishes or under ``least`` views.

    Cameras (cam, p of 12) are few: their matrices travel with the tasks, so a view is three numbers in the shuffle. The views of a point
    meet in one row; points of equally many views are decomposed in one batch. The confidence is 0.7 of how far the weighted reprojection
    error stays under 10 pixels and 0.3 of how far the condition number stays under 100, both between 0 and 1.
    """
    import numpy as np
    import pyarrow as pa

    matrices = {r[0]: r[1] for r in cameras.select(cameras_of, "p").limit(CAMERAS + 1).collect()}
    if len(matrices) > CAMERAS:
        raise ValueError(f"more than {CAMERAS} cameras")
    order = {c: i for i, c in enumerate(sorted(matrices))}
    shipped = views.sparkSession.sparkContext.broadcast(np.array([matrices[c] for c in order]).reshape(-1, 3, 4))
    place = F.create_map(*(F.lit(x) for c, i in order.items() for x in (c, i)))[F.col(cameras_of)]
    g = views.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(place.alias("c"), "u", "v", "conf"))).alias("o")).where(F.size("o") >= least)
    ddl = ", ".join([*(f"{k} {g.schema[k].dataType.simpleString()}" for k in keys), "x double", "y double", "z double", "confidence double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys))
            flat, cuts = lists.flatten(), np.asarray(lists.offsets)
            cuts = cuts - cuts[0]
            c, u, v, w = (np.asarray(flat.field(k)) for k in range(4))
            sizes, out = np.diff(cuts), np.full((batch.num_rows, 4), np.nan)
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                rows = cuts[at][:, None] + np.arange(n)
                p, uu, vv, ww = shipped.value[c[rows]], u[rows], v[rows], w[rows]
                a = np.concatenate([ww[..., None] * (uu[..., None] * p[:, :, 2] - p[:, :, 0]), ww[..., None] * (vv[..., None] * p[:, :, 2] - p[:, :, 1])], axis=1)
                _, s, h = np.linalg.svd(a)
                h = h[:, -1]
                fine = np.abs(h[:, 3]) >= 1e-10
                point = h[fine] / h[fine, 3:]
                back = np.einsum("nvij,nj->nvi", p[fine], point)
                sees = np.abs(back[..., 2]) >= 1e-10
                down = np.where(sees, back[..., 2], 1.0)
                error = np.hypot(back[..., 0] / down - uu[fine], back[..., 1] / down - vv[fine])
                weight = np.where(sees, ww[fine], 0.0)
                total = weight.sum(axis=1)
                mean = np.where(total > 0, (weight * error).sum(axis=1) / np.where(total > 0, total, 1.0), np.inf)
                near = np.clip(1 - mean / 10, 0, 1)
                firm = np.clip(100 * (s[fine, -1] + 1e-10) / s[fine, 0], 0, 1)
                out[at[fine], :3], out[at[fine], 3] = point[:, :3], np.where(sees.any(axis=1), 0.7 * near + 0.3 * firm, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array(out[:, k], mask=np.isnan(out[:, k])) for k in range(4))], names=[*keys, "x", "y", "z", "confidence"])

    return g.mapInArrow(run, ddl)


def triangulated_poses(views: DataFrame, cameras: DataFrame, keypoints: int, least: int = 2, conf: float = 0.0) -> DataFrame:
    """(video_id, frame, instance, kps array<struct<x, y, z, conf>>): each keypoint from its views of more than ``conf``, null where too few."""
    t = triangulate(views.where(F.col("conf") > conf), cameras, [*P.KEYS, "keypoint"], least)
    none = F.struct(*(F.lit(None).cast("double").alias(c) for c in ("x", "y", "z", "conf")))
    point = F.struct("x", "y", "z", F.col("confidence").alias("conf"))
    g = t.groupBy(*P.KEYS).agg(*(F.max(F.when(F.col("keypoint") == k, point)).alias(f"k{k}") for k in range(keypoints)))
    return g.select(*P.KEYS, F.array(*(F.coalesce(f"k{k}", none) for k in range(keypoints))).alias("kps"))


def velocity3d(track: DataFrame, keys: list[str], back: int = 5, order: str = "frame", keypoint: str = "keypoint", least: int = 2) -> DataFrame:
    """(keys, order, speed): norms of the slopes of weighted linear fits over each keypoint's trailing frames, averaged over the keypoints.

    Weights are conf - min(conf) + 1e-8 in the window; a keypoint with under ``least`` frames there has no speed. The frames asked for
    are those of the keys' rows; a keypoint that is absent from one still has its frames before it.
    """
    places = track.select(*keys, order).distinct()
    points = track.select(*keys, keypoint).distinct()
    some = track.where("x is not null and y is not null and z is not null").select(*keys, keypoint, order, "x", "y", "z", "conf")
    grid = places.join(points, keys).join(some, [*keys, keypoint, order], "left")
    w = Window.partitionBy(*keys, keypoint).orderBy(order).rangeBetween(-back, 0)
    # a window holds back + 1 rows at most; sums are taken about the weighted means, which differences of large sums would not survive
    row = F.when(F.col("x").isNotNull(), F.struct(F.col(order).cast("double").alias("t"), "x", "y", "z", "conf"))
    near = grid.withColumn("o", F.collect_list(row).over(w)).where(F.size("o") >= least)
    near = near.withColumn("low", F.array_min(F.transform("o", lambda o: o["conf"])))
    near = near.withColumn("o", F.transform("o", lambda o: F.struct(o["t"].alias("t"), o["x"].alias("x"), o["y"].alias("y"), o["z"].alias("z"), (o["conf"] - F.col("low") + 1e-8).alias("w"))))
    total = lambda f: F.aggregate(F.transform("o", f), F.lit(0.0), lambda s, v: s + v)
    near = near.withColumn("_w", total(lambda o: o["w"]))
    for c in ("t", "x", "y", "z"):
        near = near.withColumn(f"_m{c}", total(_weighted(c)) / F.col("_w"))
    down = total(lambda o: o["w"] * (o["t"] - F.col("_mt")) * (o["t"] - F.col("_mt")))
    up = [total(_moment(c)) for c in "xyz"]
    speed = F.sqrt(up[0] * up[0] + up[1] * up[1] + up[2] * up[2]) / down
    return near.select(*keys, order, speed.alias("speed")).groupBy(*keys, order).agg(F.avg("speed").alias("speed"))


def _weighted(c: str):
    return lambda o: o["w"] * o[c]


def _moment(c: str):
    return lambda o: o["w"] * (o["t"] - F.col("_mt")) * (o[c] - F.col(f"_m{c}"))


# --- centres, agreement, calibration ---

def anatomical_center(pose: DataFrame, head: int, center: int, tail: int, least: int = 3) -> DataFrame:
    """Columns cx, cy: the centre keypoint once missing keypoints are filled, else the centroid."""
    p = P.with_centroid(fill_missing(pose, P.canonical(pose, head, tail), least))
    k = F.get("kps", F.lit(center))
    return p.withColumn("cx", F.coalesce(k["x"], "cx")).withColumn("cy", F.coalesce(k["y"], "cy"))


def aligned_local(pose: DataFrame, head: int, center: int, tail: int) -> DataFrame:
    """Keypoints about the anatomical centre, rotated by minus the angle; absent ones stay absent, confidence stays."""
    at = anatomical_center(pose, head, center, tail).select(*P.KEYS, F.col("cx").alias("ax"), F.col("cy").alias("ay"))
    r = P.rotation(pose, head, center, tail).join(at, P.KEYS)
    move = lambda p: F.struct((p["x"] - F.col("ax")).alias("x"), (p["y"] - F.col("ay")).alias("y"), p["conf"].alias("conf"))
    return r.withColumn("kps", F.transform("kps", lambda p: P.turned(move(p), -F.col("angle"))))


def agreement(samples: DataFrame, least: float = 0.3) -> DataFrame:
    """(video_id, frame, agreement): half a point for each sure sample whose cluster is its motion id; clusters of a video are flipped if
    under half agree. Frames without sure samples have no row."""
    sure = samples.where(F.col("confidence") >= least)
    same = F.col("cluster") == F.col("motion_id")
    flip = sure.groupBy("video_id").agg((F.avg(same.cast("double")) < 0.5).alias("flip"))
    return sure.join(flip, "video_id").groupBy("video_id", "frame").agg(F.sum(F.when(same != F.col("flip"), 0.5).otherwise(0.0)).alias("agreement"))


def cameras_together(by_cam: dict[int, DataFrame]) -> DataFrame:
    """One table with a column cam, cut to the frames that the shortest camera of each video has."""
    rows = None
    for cam, t in by_cam.items():
        t = t.withColumn("cam", F.lit(cam))
        rows = t if rows is None else rows.unionByName(t, allowMissingColumns=True)
    shortest = rows.groupBy("video_id", "cam").agg(F.max("frame").alias("last")).groupBy("video_id").agg(F.min("last").alias("last"))
    return rows.join(shortest, "video_id").where(F.col("frame") <= F.col("last")).drop("last")


def calibrated(cameras: DataFrame) -> DataFrame:
    """Columns p (12), position and direction of cameras (k array of 9, r array of 9, t array of 3): P = K [R t], -R't, third row of R."""
    dot = lambda i, c: sum((F.col("k")[3 * i + j] * c(j) for j in range(1, 3)), F.col("k")[3 * i] * c(0))
    right = lambda col: (lambda j: F.col("r")[3 * j + col]) if col < 3 else (lambda j: F.col("t")[j])
    p = F.array(*(dot(i, right(col)) for i in range(3) for col in range(4)))
    position = F.array(*(-(F.col("r")[i] * F.col("t")[0] + F.col("r")[3 + i] * F.col("t")[1] + F.col("r")[6 + i] * F.col("t")[2]) for i in range(3)))
    return cameras.withColumn("p", p).withColumn("position", position).withColumn("direction", F.slice("r", 7, 3))


def undistorted(points: DataFrame, k: tuple[float, float, float, float], lens: tuple[float, float, float, float], steps: int = 5) -> DataFrame:
    """Pixel places (x, y) without lens distortion by fixed-point steps; k: fx, fy, cx, cy; lens: k1, k2 (radial), p1, p2 (tangential).

    Each step is a projection of its own: columns, not the state of a fold, carry the point.
    """
    fx, fy, cx, cy = k
    k1, k2, p1, p2 = lens
    x, y = F.col("_x"), F.col("_y")
    out = points.withColumns({"_x0": (F.col("x") - cx) / fx, "_y0": (F.col("y") - cy) / fy}).withColumns({"_x": F.col("_x0"), "_y": F.col("_y0")})
    for _ in range(steps):
        r2 = x * x + y * y
        radial = 1 + (k1 + k2 * r2) * r2
        dx, dy = 2 * p1 * x * y + p2 * (r2 + 2 * x * x), p1 * (r2 + 2 * y * y) + 2 * p2 * x * y
        out = out.withColumns({"_x": (F.col("_x0") - dx) / radial, "_y": (F.col("_y0") - dy) / radial})
    return out.withColumns({"x": x * fx + cx, "y": y * fy + cy}).drop("_x0", "_y0", "_x", "_y")


def roi_frames(speeds: DataFrame, scores: DataFrame, instance: int = 1, speed: float = 20.0, score: float = 50.0) -> DataFrame:
    """(video_id, frame) worth a look: one animal's speed (video_id, frame, instance, speed) or the frame's swap score (video_id, frame, score)
    reaches its bound."""
    fast = speeds.where((F.col("instance") == instance) & (F.col("speed") >= speed)).select("video_id", "frame")
    return fast.union(scores.where(F.col("score") >= score).select("video_id", "frame")).distinct()
