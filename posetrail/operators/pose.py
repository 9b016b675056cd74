"""Row-local pose operators on ``pose``: video_id, frame, instance, kps array<struct<x, y, conf>> with nulls for what is absent.

Everything here is a narrow projection over higher-order functions, except where a docstring says that a video's statistic is joined in.
Comparisons with absent values are false.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posetrail.operators import numbers as N
from posetrail.operators import runs as R
from posetrail.operators import tracks

KEYS = ["video_id", "frame", "instance"]
POINT = "struct<x:double,y:double,conf:double>"


# --- layouts ---

def to_arrays(long: DataFrame, k: int, dealt: bool = False) -> DataFrame:
    """Long rows to one row per pose; keypoints without a row become null structs' fields. Rows are dealt by frame, which serves groupings
    by pose and by frame alike; ``dealt`` says that they lie so already."""
    points = [F.max(F.when(F.col("keypoint") == i, F.struct("x", "y", "conf"))).alias(f"k{i}") for i in range(k)]
    blank = F.struct(*(F.lit(None).cast("double").alias(c) for c in ("x", "y", "conf")))
    long = long if dealt else long.repartition("video_id", "frame")
    return long.groupBy(*KEYS).agg(*points).select(*KEYS, F.array(*(F.coalesce(f"k{i}", blank) for i in range(k))).alias("kps"))


def to_long(pose: DataFrame, absent: bool = False) -> DataFrame:
    out = pose.select(*KEYS, F.posexplode("kps").alias("keypoint", "p")).select(*KEYS, "keypoint", "p.x", "p.y", "p.conf")
    return out if absent else out.where("x is not null or y is not null or conf is not null")


def to_wide(pose: DataFrame, names: list[str], individuals: int, conf: bool = True) -> DataFrame:
    """One row per frame, a column per individual, keypoint and coordinate; the first non-null value of each."""
    parts = ("x", "y", "conf") if conf else ("x", "y")
    first = [
        F.first(F.when(F.col("instance") == i, F.col("kps")[k][c]), ignorenulls=True).alias(f"i{i}_{n}_{c}")
        for i in range(individuals) for k, n in enumerate(names) for c in parts
    ]
    return pose.groupBy("video_id", "frame").agg(*first)


def from_wide(wide: DataFrame, names: list[str], individuals: int, conf: bool = True) -> DataFrame:
    """The reverse of to_wide: checks the columns, adds a confidence where absent, negatives to null, absent poses dropped."""
    need = {f"i{i}_{n}_{c}" for i in range(individuals) for n in names for c in (("x", "y", "conf") if conf else ("x", "y"))}
    if need - set(wide.columns):
        raise ValueError(f"missing columns: {sorted(need - set(wide.columns))[:5]}")
    one = lambda i, n, c: F.col(f"i{i}_{n}_{c}")
    mock = lambda i, n: F.when(one(i, n, "x").isNotNull() & one(i, n, "y").isNotNull(), F.lit(1.0))
    poses = F.array(*(
        F.struct(F.lit(i).alias("instance"), F.array(*(F.struct(one(i, n, "x").alias("x"), one(i, n, "y").alias("y"), (one(i, n, "conf") if conf else mock(i, n)).alias("conf")) for n in names)).alias("kps"))
        for i in range(individuals)
    ))
    out = wide.select("video_id", "frame", F.explode(poses).alias("p")).select("video_id", "frame", "p.instance", "p.kps")
    return neg_to_null(out).where(F.exists("kps", lambda p: p["x"].isNotNull() | p["y"].isNotNull() | p["conf"].isNotNull()))


def _points(f) -> Column:
    return F.transform("kps", f)


def _point(x: Column, y: Column, conf: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), conf.cast("double").alias("conf"))


def _none() -> Column:
    return F.lit(None).cast("double")


def _of(c: str):
    return lambda p: p[c]


def seen(p: Column) -> Column:
    return p["x"].isNotNull() & p["y"].isNotNull()


def visible(kps: str = "kps") -> Column:
    return F.size(F.filter(kps, seen))


def _mean(values: Column) -> Column:
    """Mean of an array's non-null values, null if none."""
    some = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda s, v: s + v) / F.size(some))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


# --- projections and filters ---

def mock_conf(pose: DataFrame) -> DataFrame:
    return pose.withColumn("kps", _points(lambda p: _point(p["x"], p["y"], F.when(seen(p), F.lit(1.0)))))


def drop_conf(pose: DataFrame) -> DataFrame:
    return pose.withColumn("kps", _points(lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))


def neg_to_null(pose: DataFrame) -> DataFrame:
    return pose.withColumn("kps", _points(lambda p: _point(*(F.when(p[c] >= 0, p[c]) for c in ("x", "y", "conf")))))


def kp_reorder(pose: DataFrame, order: list[int]) -> DataFrame:
    """Keypoints of the file put into the project's order: order[i] is the file's place of keypoint i. Another length leaves them."""
    return pose.withColumn("kps", F.when(F.size("kps") == len(order), F.array(*(F.get("kps", F.lit(i)) for i in order))).otherwise(F.col("kps")))


def crop_shift(pose: DataFrame, roi: DataFrame, sign: int = 1) -> DataFrame:
    """Add (or with -1 subtract) the crop origin; roi has a few numbers per video."""
    j = pose.join(roi.select("video_id", "x1", "y1"), "video_id")
    return j.withColumn("kps", _points(lambda p: _point(p["x"] + sign * F.col("x1"), p["y"] + sign * F.col("y1"), p["conf"]))).drop("x1", "y1")


def clean_inconsistent(pose: DataFrame) -> DataFrame:
    return pose.withColumn("kps", _points(lambda p: _point(*(F.when(seen(p), p[c]) for c in ("x", "y", "conf")))))


def _keep(pose: DataFrame, condition) -> DataFrame:
    return pose.withColumn("kps", _points(lambda p: _point(*(F.when(seen(p) & F.coalesce(condition(p), F.lit(False)), p[c]) for c in ("x", "y", "conf")))))


def outside_roi(pose: DataFrame, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    """Null what is outside the half-open box."""
    return _keep(pose, lambda p: (p["x"] >= x1) & (p["x"] < x2) & (p["y"] >= y1) & (p["y"] < y2))


def inside_zone(pose: DataFrame, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    """Null what is inside the closed box."""
    return _keep(pose, lambda p: ~(p["x"].between(x1, x2) & p["y"].between(y1, y2)))


def masked(long: DataFrame, mask: DataFrame, width: int, height: int) -> DataFrame:
    """Long rows that do not fall on a mask pixel: coordinates truncated and clipped to the image, absent ones sampled at (0, 0)."""
    px = F.least(F.greatest(F.coalesce(F.col("x").cast("int"), F.lit(0)), F.lit(0)), F.lit(width - 1))
    py = F.least(F.greatest(F.coalesce(F.col("y").cast("int"), F.lit(0)), F.lit(0)), F.lit(height - 1))
    at = long.withColumn("px", px).withColumn("py", py)
    return at.join(mask.select("video_id", F.col("x").alias("px"), F.col("y").alias("py")), ["video_id", "px", "py"], "left_anti").drop("px", "py")


def conf_cut(pose: DataFrame, cutoff: float, closed: bool = False) -> DataFrame:
    return pose.withColumn("kps", F.filter("kps", lambda p: seen(p) & ((p["conf"] >= cutoff) if closed else (p["conf"] > cutoff))))


def frame_count(pose: DataFrame, least: int, most: int) -> DataFrame:
    """(video_id, frame) of the first ``most`` frames of each video with ``least`` animals at least."""
    counts = pose.where(visible() > 0).groupBy("video_id", "frame").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("video_id").orderBy("frame"))).where(F.col("r") <= most).select("video_id", "frame")


def remove(pose: DataFrame, mask: Column) -> DataFrame:
    """Null the whole pose where the mask holds."""
    return pose.withColumn("kps", F.when(F.coalesce(mask, F.lit(False)), _points(lambda p: _point(_none(), _none(), _none()))).otherwise(F.col("kps")))


def remove_points(pose: DataFrame, mask: str) -> DataFrame:
    """Null each keypoint whose flag in the array column ``mask`` holds."""
    return pose.withColumn("kps", F.zip_with("kps", mask, lambda p, m: _point(*(F.when(~F.coalesce(m, F.lit(False)), p[c]) for c in ("x", "y", "conf"))))).drop(mask)


# --- geometry ---

def centroid(kps: str = "kps") -> tuple[Column, Column]:
    return tuple(_mean(F.transform(kps, _of(c))) for c in ("x", "y"))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns, as a generated row: later projections are not merged with what works them out."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*(v.alias(n) for n, v in columns.items())))))


def with_centroid(pose: DataFrame) -> DataFrame:
    cx, cy = centroid()
    return once(pose, cx=cx, cy=cy)


def local(pose: DataFrame) -> DataFrame:
    """Centroid, and keypoints relative to it."""
    return with_centroid(pose).withColumn("kps", _points(lambda p: _point(p["x"] - F.col("cx"), p["y"] - F.col("cy"), p["conf"])))


def bbox(pose: DataFrame, padding: float) -> DataFrame:
    """Padded box: padding is a percentage of width and height."""
    xs, ys = (F.transform("kps", _of(c)) for c in ("x", "y"))
    b = pose.select(*KEYS, F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))
    px, py = (F.col("x2") - F.col("x1")) * padding / 100, (F.col("y2") - F.col("y1")) * padding / 100
    return b.select(*KEYS, (F.col("x1") - px).alias("x1"), (F.col("y1") - py).alias("y1"), (F.col("x2") + px).alias("x2"), (F.col("y2") + py).alias("y2"))


def rotation(pose: DataFrame, head: int, center: int, tail: int) -> DataFrame:
    """Column angle: circular mean of the vectors center-head, tail-head and tail-center that are there; else the principal axis of the
    present keypoints, turned towards the head or away from the tail (with neither: to the right); under two keypoints 0."""
    pt = lambda i: F.get("kps", F.lit(i))
    vector = lambda a, b: F.when(seen(pt(a)) & seen(pt(b)), F.atan2(pt(b)["y"] - pt(a)["y"], pt(b)["x"] - pt(a)["x"]))
    angles = F.filter(F.array(vector(center, head), vector(tail, head), vector(tail, center)), lambda v: v.isNotNull())
    mean = F.atan2(_sum(F.transform(angles, F.sin)), _sum(F.transform(angles, F.cos)))
    p = once(with_centroid(pose), angles=angles)
    there = F.filter("kps", seen)
    dx, dy = (lambda q: q["x"] - F.col("cx")), (lambda q: q["y"] - F.col("cy"))
    sxx, syy, sxy = _sum(F.transform(there, lambda q: dx(q) * dx(q))), _sum(F.transform(there, lambda q: dy(q) * dy(q))), _sum(F.transform(there, lambda q: dx(q) * dy(q)))
    axis = F.when(F.size("angles") == 0, F.atan2(2 * sxy, sxx - syy) / 2)  # only there is it used
    p = once(p, axis=axis)
    towards = lambda q: F.cos("axis") * dx(q) + F.sin("axis") * dy(q)
    turned = F.when(seen(pt(head)), towards(pt(head)) < 0).when(seen(pt(tail)), towards(pt(tail)) > 0).otherwise(F.cos("axis") < 0)
    fallback = F.when(turned, F.atan2(-F.sin("axis"), -F.cos("axis"))).otherwise(F.col("axis"))
    return once(p, angle=F.when(F.size("angles") > 0, mean).when(visible() < 2, F.lit(0.0)).otherwise(fallback)).drop("angles", "axis")


def turned(p: Column, by: Column) -> Column:
    return _point(p["x"] * F.cos(by) - p["y"] * F.sin(by), p["x"] * F.sin(by) + p["y"] * F.cos(by), p["conf"])


def aligned(pose: DataFrame, head: int, center: int, tail: int) -> DataFrame:
    """Keypoints relative to the centroid, rotated by minus the angle."""
    r = rotation(pose, head, center, tail)
    return r.withColumn("kps", _points(lambda p: turned(_point(p["x"] - F.col("cx"), p["y"] - F.col("cy"), p["conf"]), -F.col("angle"))))


def canonical(pose: DataFrame, head: int, tail: int) -> DataFrame:
    """(video_id, keypoint, cx, cy): mean over the video of poses with head and tail, centred and turned so that tail-head is +x."""
    h, t = F.get("kps", F.lit(head)), F.get("kps", F.lit(tail))
    p = once(with_centroid(pose.where(seen(h) & seen(t))), by=-F.atan2(h["y"] - t["y"], h["x"] - t["x"]))
    p = p.withColumn("kps", _points(lambda q: turned(_point(q["x"] - F.col("cx"), q["y"] - F.col("cy"), q["conf"]), F.col("by"))))
    return to_long(p, absent=True).groupBy("video_id", "keypoint").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def angle_map(canon: DataFrame) -> DataFrame:
    """(video_id, center_idx): the keypoint nearest to the canonical origin; ties go to the lowest."""
    return canon.groupBy("video_id").agg(F.min_by("keypoint", F.struct(F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy"), F.col("keypoint"))).alias("center_idx"))


def zoom_box(pose: DataFrame, padding: float = 100.0) -> DataFrame:
    """Extent of all animals of a frame and the zoom, within [0.1, 3], that fits it on 1000 x 1000."""
    xs, ys = (F.transform("kps", _of(c)) for c in ("x", "y"))
    b = pose.groupBy("video_id", "frame").agg(F.min(F.array_min(xs)).alias("x1"), F.min(F.array_min(ys)).alias("y1"), F.max(F.array_max(xs)).alias("x2"), F.max(F.array_max(ys)).alias("y2"))
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) + padding
    return b.select("video_id", "frame", ((F.col("x1") + F.col("x2")) / 2).alias("mx"), ((F.col("y1") + F.col("y2")) / 2).alias("my"), F.least(F.greatest(1000 / side, F.lit(0.1)), F.lit(3.0)).alias("zoom"))


def body_length(pose: DataFrame, head: int, tail: int) -> DataFrame:
    """(video_id, body_length): exact median of the head-tail distance."""
    h, t = F.get("kps", F.lit(head)), F.get("kps", F.lit(tail))
    lengths = N.grouped_quantile(pose.where(seen(h) & seen(t)), ["video_id"], F.hypot(h["x"] - t["x"], h["y"] - t["y"]), 0.5)
    return lengths.withColumnRenamed("quantile", "body_length")


# --- outlier masks ---

def out_confidence(threshold: float = 0.5) -> Column:
    return F.coalesce(_mean(F.transform(F.filter("kps", seen), lambda p: p["conf"])) < threshold, F.lit(False))


def out_confidence_kp(pose: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(keys, keypoint) of present keypoints below the confidence."""
    rows = pose.select(*KEYS, F.posexplode("kps").alias("keypoint", "p"))
    return rows.where(seen(F.col("p")) & (F.col("p.conf") < threshold)).select(*KEYS, "keypoint")


def out_bodypart(threshold: int = 2) -> Column:
    return (visible() > 0) & (visible() < threshold)


def radius() -> Column:
    """Mean distance of the keypoints to cx, cy."""
    return _mean(F.transform("kps", lambda p: F.sqrt((p["x"] - F.col("cx")) * (p["x"] - F.col("cx")) + (p["y"] - F.col("cy")) * (p["y"] - F.col("cy")))))


def out_size(pose: DataFrame, low: float = 0.3, high: float = 2.5) -> DataFrame:
    """Column out: the pose's radius is below low or from high times the video's mean. The mean is one row per video, joined back."""
    r = with_centroid(pose).withColumn("r", radius())
    m = r.groupBy("video_id").agg(F.avg("r").alias("m"))
    return r.join(m, "video_id").withColumn("out", F.coalesce((F.col("r") < F.col("m") * low) | (F.col("r") >= F.col("m") * high), F.lit(False))).drop("r", "m", "cx", "cy")


def bone_flags(pose: DataFrame, bones: list[tuple[int, int]], threshold: float = 2.0) -> DataFrame:
    """(keys, bone, a, b, bad): a bone is bad if its length over its exact 75th percentile in the video exceeds the threshold."""
    length = lambda a, b: F.hypot(F.col("kps")[a]["x"] - F.col("kps")[b]["x"], F.col("kps")[a]["y"] - F.col("kps")[b]["y"])
    all_bones = F.array(*(F.struct(F.lit(i).alias("bone"), F.lit(a).alias("a"), F.lit(b).alias("b"), length(a, b).alias("len")) for i, (a, b) in enumerate(bones)))
    e = pose.select(*KEYS, F.explode(all_bones).alias("e")).select(*KEYS, "e.*")
    ref = N.grouped_quantile(e, ["video_id", "bone"], F.col("len"), 0.75).select("video_id", "bone", F.greatest("quantile", F.lit(1e-8)).alias("ref"))
    return e.join(ref, ["video_id", "bone"], "left").select(*KEYS, "bone", "a", "b", F.coalesce(F.col("len") / F.col("ref") > threshold, F.lit(False)).alias("bad"))


def active(bones: list[tuple[int, int]], ignored: tuple[tuple[int, int], ...]) -> list[tuple[int, int]]:
    """The bones that are not ignored, whichever end comes first."""
    off = {frozenset(b) for b in ignored}
    return [b for b in bones if frozenset(b) not in off]


def out_bone(pose: DataFrame, bones: list[tuple[int, int]], threshold: float = 2.0, ignored: tuple[tuple[int, int], ...] = ()) -> DataFrame:
    return bone_flags(pose, active(bones, ignored), threshold).groupBy(*KEYS).agg(F.max("bad").alias("out"))


def out_bone_kp(pose: DataFrame, bones: list[tuple[int, int]], threshold: float = 2.0, ignored: tuple[tuple[int, int], ...] = ()) -> DataFrame:
    """(keys, keypoint): one bad bone suffices at a leaf of the skeleton of active bones, else two."""
    bones = active(bones, ignored)
    degree: dict[int, int] = {}
    for a, b in bones:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    need = reduce(lambda c, kd: F.when(F.col("keypoint") == kd[0], F.lit(1 if kd[1] == 1 else 2)).otherwise(c), degree.items(), F.lit(99))
    ends = bone_flags(pose, bones, threshold).where("bad").select(*KEYS, F.explode(F.array("a", "b")).alias("keypoint"))
    return ends.groupBy(*KEYS, "keypoint").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= need).select(*KEYS, "keypoint")


def out_rotation(head: int, center: int, tail: int, threshold: float = 10.0) -> Column:
    h, c, t = (F.get("kps", F.lit(i)) for i in (head, center, tail))
    ax, ay, bx, by = h["x"] - c["x"], h["y"] - c["y"], t["x"] - c["x"], t["y"] - c["y"]
    return F.coalesce(F.degrees(F.atan2(F.abs(ax * by - ay * bx), ax * bx + ay * by)) < threshold, F.lit(False))


def pairs(pose: DataFrame) -> DataFrame:
    """Rows (video_id, frame, i, j, kps_i, kps_j) of the present poses i < j of a frame; the poses of a frame meet once."""
    one = F.struct("instance", "kps")
    frames = pose.where(visible() > 0).groupBy("video_id", "frame").agg(F.sort_array(F.collect_list(one)).alias("all"))
    each = F.flatten(F.transform("all", lambda a: F.transform(F.filter("all", lambda b: b["instance"] > a["instance"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    out = frames.where(F.size("all") > 1).select("video_id", "frame", F.explode(each).alias("p"))
    return out.select("video_id", "frame", F.col("p.a.instance").alias("i"), F.col("p.b.instance").alias("j"), F.col("p.a.kps").alias("kps_i"), F.col("p.b.kps").alias("kps_j"))


def out_duplicate(pose: DataFrame, ratio: float = 0.5, distance: float = 5.0) -> DataFrame:
    """(video_id, frame, instance) of poses that lie on another one."""
    near = F.zip_with("kps_i", "kps_j", lambda a, b: F.coalesce(F.hypot(a["x"] - b["x"], a["y"] - b["y"]) <= distance, F.lit(False)))
    conf = lambda c: _mean(F.transform(F.filter(c, seen), lambda p: p["conf"]))
    p = pairs(pose).select(
        "video_id", "frame", "i", "j", F.size(F.filter(near, lambda v: v)).alias("close"), visible("kps_i").alias("n_i"), visible("kps_j").alias("n_j"), conf("kps_i").alias("c_i"), conf("kps_j").alias("c_j")
    )
    p = p.where((F.col("close") > 0) & (F.col("close") >= F.least("n_i", "n_j") * ratio))
    by_conf = F.when(F.col("c_i") >= F.col("c_j"), F.col("j")).otherwise(F.col("i"))
    by_size = F.when(F.col("n_i") > F.col("n_j"), F.col("j")).otherwise(F.col("i"))
    worse = F.when(F.col("close") > F.greatest("n_i", "n_j") * ratio, by_conf).otherwise(by_size)
    return p.select("video_id", "frame", worse.alias("instance")).distinct()


def out_envelop(pose: DataFrame, padding: float = 20.0) -> DataFrame:
    """(video_id, frame, instance) of poses that lie strictly inside the padded box of a larger one."""
    def big(c: str) -> Column:
        mx, my = F.col(f"x_{c}"), F.col(f"y_{c}")
        return F.array_max(F.transform(c, lambda p: (p["x"] - mx) * (p["x"] - mx) + (p["y"] - my) * (p["y"] - my)))

    middles = {f"{a}_{c}": v for c in ("kps_i", "kps_j") for a, v in zip("xy", centroid(c), strict=True)}
    p = once(once(pairs(pose), **middles), first=big("kps_i") >= big("kps_j"))
    p = p.select("video_id", "frame", F.when(F.col("first"), F.col("j")).otherwise(F.col("i")).alias("instance"), F.when(F.col("first"), F.col("kps_i")).otherwise(F.col("kps_j")).alias("large"), F.when(F.col("first"), F.col("kps_j")).otherwise(F.col("kps_i")).alias("small"))
    lo = {c: F.array_min(F.transform("large", _of(c))) for c in "xy"}
    hi = {c: F.array_max(F.transform("large", _of(c))) for c in "xy"}
    p = once(p, **{f"{c}{k}": end + sign * (hi[c] - lo[c]) * padding / 100 for c in "xy" for k, end, sign in ((1, lo[c], -1), (2, hi[c], 1))})
    inside = F.forall(F.filter("small", seen), lambda q: (q["x"] > F.col("x1")) & (q["x"] < F.col("x2")) & (q["y"] > F.col("y1")) & (q["y"] < F.col("y2")))
    return p.where(inside).select("video_id", "frame", "instance").distinct()


def track():
    """The frames of an animal of a video in order."""
    return Window.partitionBy("video_id", "instance").orderBy("frame")


def out_speed(pose: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Column out: the centroid moved further than the threshold since the frame before; absent rows are gaps."""
    p = with_centroid(pose.where(visible() > 0))
    lag = lambda c: F.lag(c).over(track())
    moved = F.hypot(F.col("cx") - lag("cx"), F.col("cy") - lag("cy")) > threshold
    return p.withColumn("out", F.coalesce(moved & (lag("frame") == F.col("frame") - 1), F.lit(False))).drop("cx", "cy")


def out_jump_kp(pose: DataFrame, threshold: float = 50.0) -> DataFrame:
    """(keys, keypoint) of keypoints that moved further than the threshold since the frame before."""
    p = pose.withColumn("was", F.lag("kps").over(track())).withColumn("at", F.lag("frame").over(track())).where(F.col("at") == F.col("frame") - 1)
    far = F.zip_with("kps", "was", lambda a, b: F.coalesce(F.hypot(a["x"] - b["x"], a["y"] - b["y"]) > threshold, F.lit(False)))
    return p.select(*KEYS, F.posexplode(far).alias("keypoint", "far")).where("far").select(*KEYS, "keypoint")


def out_flicker(pose: DataFrame) -> DataFrame:
    """(keys) of poses that are there in one frame only, with none in the frames before and after."""
    p = pose.where(visible() > 0)
    before = F.coalesce(F.lag("frame").over(track()) == F.col("frame") - 1, F.lit(False))
    after = F.coalesce(F.lead("frame").over(track()) == F.col("frame") + 1, F.lit(False))
    return p.withColumn("alone", ~before & ~after).where("alone").select(*KEYS)


def weighted_vectors(pose: DataFrame, pairs: list[tuple[int, int, float]], least: float = 0.1, most: int = 6) -> DataFrame:
    """Column vectors: weight * (j - i) of the first ``most`` pairs (i, j, weight) of the least weight; null parts where an end is absent."""
    at = lambda k: F.get("kps", F.lit(k))
    kept = [t for t in pairs if t[2] >= least][:most]
    vectors = [F.struct(*((F.lit(w) * (at(j)[c] - at(i)[c])).alias(f"d{c}") for c in "xy")) for i, j, w in kept]
    return pose.withColumn("vectors", F.array(*vectors))


def cutout_size(aligned_pose: DataFrame, margin: float = 1.15) -> DataFrame:
    """(video_id, size): the larger 90th percentile of widths and heights with a margin, truncated, made even."""
    b = bbox(aligned_pose, 0.0)
    sides = b.select("video_id", F.posexplode(F.array(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("axis", "side"))
    s = N.grouped_quantile(sides, ["video_id", "axis"], F.col("side"), 0.9).groupBy("video_id").agg(F.floor(F.round(F.max("quantile") * margin, 6)).cast("bigint").alias("s"))
    return s.select("video_id", (F.col("s") + F.col("s") % 2).alias("size"))


def dense(tracks: DataFrame) -> DataFrame:
    """(video_id, instance, keypoint, frame) of each frame up to the last of (video_id, instance, keypoint, last).

    The tracks are few bytes, so their shuffles end in a task or two; blocks of frames are dealt before they become rows.
    """
    key = ["video_id", "instance", "keypoint"]
    blocks = tracks.select(*key, "last", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"last div {R.BLOCK}"))).alias("block"))
    dealt = blocks.repartition(2 * tracks.sparkSession.sparkContext.defaultParallelism, *key, "block")
    start = F.col("block") * R.BLOCK
    return dealt.select(*key, F.explode(F.sequence(start, F.least(start + R.BLOCK - 1, F.col("last")))).alias("frame"))


def interpolated(long: DataFrame, max_gap: int = 0) -> DataFrame:
    """x, y and conf of every keypoint on each frame up to the video's last, linear with edges held; frames of whole-instance gaps over
    max_gap are null again (0: no limit). One row per track, keypoint and frame."""
    return tracks.interpolated(long, max_gap)
