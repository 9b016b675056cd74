"""Average poses, absent animals, and edits by tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posetrail.operators import pose as P
from posetrail.operators import runs as R

#: Half windows of an average pose: 30 frames, doubled nine times at most.
RANGE, ATTEMPTS, ENOUGH = 30, 10, 30
#: Frames of a track that a task averages at once, and those that the widest window reaches before and after a frame.
TRACK, REACH = 65_536, RANGE * 2**ATTEMPTS + 1


def average_pose(pose: DataFrame, requests: DataFrame, total: DataFrame, head: int, center: int, tail: int, conf: float = 0.5, least: int = 3) -> DataFrame:
    """(video_id, frame, instance, kps) of the requested (video_id, frame, instance[, cx, cy, angle]): the mean pose of the instance around the frame.

    The window is the frame and 30 on each side, shifted inwards at the ends of the video of (video_id, total) frames, and doubled up to
    nine times until it holds more than 30 usable poses: of mean confidence ``conf`` or more and ``least`` keypoints. Their keypoints are
    aligned about the centroid, averaged, turned by the circular mean of their angles and put at the mean centroid; a requested centre or
    angle overrides these. A request without so many usable poses has no row.
    """
    return _averages(pose, requests, total, head, center, tail, conf, least).where("kps is not null")


def _averages(pose: DataFrame, requests: DataFrame, total: DataFrame, head: int, center: int, tail: int, conf: float = 0.5, least: int = 3) -> DataFrame:
    """As ``average_pose``, but a request without so many usable poses has its own column ``instead``, or null where there is none.

    Usable poses are dealt once, by track and block of frames, and those that a window of another block may reach also to that block, which
    is half of each of the longest videos' neighbours at most. There windows are counted by two searches among the sorted frames, and every
    mean is the difference of running sums (about the block's mean) at two ranks, however wide the window.
    """
    for c, kind in (("cx", "double"), ("cy", "double"), ("angle", "double"), ("instead", f"array<{P.POINT}>")):
        if c not in requests.columns:
            requests = requests.withColumn(c, F.lit(None).cast(kind))
    key = ["video_id", "instance", "_block"]
    usable = pose.where((P.visible() > 0) & ~P.out_bodypart(least) & ~P.out_confidence(conf) & (F.col("frame") >= 0))
    reached = F.sequence(F.expr(f"greatest(frame - {REACH}, 0) div {TRACK}"), F.expr(f"(frame + {REACH}) div {TRACK}"))
    dealt = usable.select(*P.KEYS, "kps", F.explode(reached).alias("_block")).repartition(*key)
    turned = P.aligned(dealt, head, center, tail).select(*key, "frame", "cx", "cy", F.sin("angle").alias("sin"), F.cos("angle").alias("cos"), "kps")
    inside = F.coalesce(F.greatest(F.least("frame", F.col("total") - 1), F.lit(0)), F.lit(0))
    asked = requests.join(total, "video_id").withColumn("total", F.col("total").cast("bigint")).withColumn("_block", F.floor(inside / TRACK))
    asked = asked.select(*(F.col(c).alias(c) for c in (*P.KEYS, "cx", "cy", "angle", "instead", "total", "_block")))  # columns apart from those of the poses
    kinds = ", ".join(f"{c} {asked.schema[c].dataType.simpleString()}" for c in P.KEYS)
    ddl = f"{kinds}, cx double, cy double, angle double, instead array<{P.POINT}>, at_x double, at_y double, turn double, mean array<{P.POINT}>"
    found = turned.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_mean_poses, ddl)
    x, y, angle = F.coalesce("cx", "at_x"), F.coalesce("cy", "at_y"), F.coalesce("angle", "turn")
    return found.select(*P.KEYS, F.when(F.size("mean") > 0, _placed("mean", x, y, angle)).otherwise(F.col("instead")).alias("kps"))


def _mean_poses(poses: pa.Table, asked: pa.Table) -> pa.Table:
    """The requests with the means over their windows among the poses of a track; no keypoints where there are too few poses."""
    poses = poses.sort_by("frame").combine_chunks()
    at, some = poses.column("frame").to_numpy(), np.asarray(asked.column("frame").is_valid())
    frame, total = (pc.fill_null(asked.column(c), 0).to_numpy().astype(np.int64) for c in ("frame", "total"))
    first, last, open_ = np.zeros(len(frame), dtype=np.int64), np.zeros(len(frame), dtype=np.int64), some & (len(at) > ENOUGH)
    for half in (RANGE * 2**k for k in range(ATTEMPTS)):
        low, high = frame - half, frame + half + 1
        shift = np.where(low < 0, -low, np.where(high > total, total - high, 0))
        low, high = (np.searchsorted(at, x) for x in (np.maximum(low + shift, 0), np.minimum(high + shift, total)))
        new = open_ & (high - low > ENOUGH)
        first[new], last[new], open_ = low[new], high[new], open_ & ~new
    done = np.flatnonzero(last > first)
    names = [c for c in asked.column_names if c not in ("total", "_block")]
    out, columns = {c: asked.column(c) for c in names}, ("at_x", "at_y", "turn")
    out["instead"] = out["instead"].cast(pa.list_(pa.struct([(c, pa.float64()) for c in ("x", "y", "conf")])))  # any of them may be null
    numbers, cuts, points = np.full((3, len(frame)), np.nan), np.zeros(len(frame) + 1, dtype=np.int32), [np.zeros(0)] * 3
    if len(done):
        ends = first[done], last[done]
        kps = poses.column("kps").combine_chunks()
        kps = kps.chunk(0) if isinstance(kps, pa.ChunkedArray) else kps
        offsets = np.asarray(kps.offsets)
        size, flat = np.diff(offsets), kps.flatten()
        k = int(size.max())
        row = np.repeat(np.arange(len(at)), size)
        place = np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], size)

        def spread(c: str) -> tuple[np.ndarray, np.ndarray]:
            """Values and whether they are there, a row for each pose."""
            v, there = np.zeros((len(at), k)), np.zeros((len(at), k), dtype=bool)
            part = flat.field(c)
            v[row, place], there[row, place] = pc.fill_null(part, 0.0).to_numpy(zero_copy_only=False), np.asarray(part.is_valid())
            return v, there

        def mean(v: np.ndarray, there: np.ndarray, about: bool = True) -> np.ndarray:
            n = there.sum(axis=0)
            middle = np.where(there, v, 0.0).sum(axis=0) / np.maximum(n, 1) if about else np.zeros(v.shape[1])
            sums, counts = (np.concatenate([np.zeros((1, v.shape[1])), np.cumsum(x, axis=0)]) for x in (np.where(there, v - middle, 0.0), there))
            n = counts[ends[1]] - counts[ends[0]]
            with np.errstate(invalid="ignore", divide="ignore"):
                return np.where(n > 0, (sums[ends[1]] - sums[ends[0]]) / n + middle, np.nan)

        (x, there), (y, _), (c, sure) = spread("x"), spread("y"), spread("conf")
        points = [v.ravel() for v in (mean(x, there), mean(y, there), mean(c, sure, about=False))]
        whole = np.column_stack([poses.column(c).to_numpy(zero_copy_only=False) for c in ("cx", "cy", "sin", "cos")])
        cx, cy, sin, cos = mean(whole, np.ones(whole.shape, dtype=bool)).T
        numbers[:, done] = cx, cy, np.arctan2(sin, cos)
        cuts[done + 1] = k
    own = pa.StructArray.from_arrays([pa.array(v, from_pandas=True) for v in points], names=["x", "y", "conf"])
    kps = pa.ListArray.from_arrays(pa.array(np.cumsum(cuts, dtype=np.int32)), own)
    return pa.table(out | {c: pa.array(v, from_pandas=True) for c, v in zip(columns, numbers, strict=True)} | {"mean": kps})


def _placed(kps: str, x: Column, y: Column, angle: Column) -> Column:
    """Keypoints about the origin, turned and moved; the confidence stays."""

    def put(p: Column) -> Column:
        t = P.turned(p, angle)
        return F.struct((t["x"] + x).alias("x"), (t["y"] + y).alias("y"), p["conf"].alias("conf"))

    return F.transform(kps, put)


def fill_absent(pose: DataFrame, total: DataFrame, individuals: int, canon: DataFrame, head: int, center: int, tail: int) -> DataFrame:
    """pose with a pose for each absent instance of the frames that hold one at least: its average pose there, or else the video's canonical
    pose at (200, 200), turned by the instance's number in radians, with confidence 1."""
    seen = pose.where(P.visible() > 0)
    here = seen.groupBy("video_id", "frame").agg(F.collect_set("instance").alias("_here"))  # the animals bound it
    absent = here.select("video_id", "frame", F.explode(F.array_except(F.array(*map(F.lit, range(individuals))), "_here")).alias("instance"))
    shape = canon.groupBy("video_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("keypoint", "cx", "cy"))), lambda c: F.struct(c["cx"].alias("x"), c["cy"].alias("y"), F.lit(1.0).alias("conf"))).alias("_shape"))
    asked = absent.join(shape, "video_id", "left").withColumn("instead", _placed("_shape", F.lit(200.0), F.lit(200.0), F.col("instance").cast("double"))).drop("_shape")
    return seen.select(*P.KEYS, "kps").unionByName(_averages(pose, asked, total, head, center, tail).where("kps is not null"))


# --- edits: (video_id, start, end, instance[, keypoint]) tables, small beside the poses; ranges reach their frames by blocks of frames ---

#: Frames of a block of edits.
EDITED = 256


def _block(frame: Column) -> Column:
    return F.floor(frame / EDITED)


def _edited(edits: DataFrame, *what: str, odd: bool = False) -> DataFrame:
    """(video_id, _block, _edits): the distinct ranges of each block, as structs of start, end and the named columns; with ``odd`` only those
    given an odd number of times. An end of -1 reaches to the last frame of the (video_id, last) column.

    Ranges are cut at the blocks' ends, so a block's frames bound what it holds. They are dealt by block before they are grouped: the
    shuffle shows Spark how many they are, where a table of videos would look small and go through one task and a broadcast.
    """
    end = F.when(F.col("end") == -1, F.col("last")).otherwise(F.col("end")) if "last" in edits.columns else F.col("end")
    rows = edits.select("video_id", "start", end.alias("end"), *what).where(F.col("start") <= F.col("end"))
    rows = rows.withColumn("_block", F.explode(F.sequence(_block(F.col("start")), _block(F.col("end")))))
    first = F.col("_block") * EDITED
    rows = rows.withColumn("start", F.greatest("start", first)).withColumn("end", F.least("end", first + EDITED - 1)).repartition("video_id", "_block")
    ranges = rows.groupBy("video_id", "_block", "start", "end", *what).agg(F.count(F.lit(1)).alias("_n"))
    if odd:
        ranges = ranges.where(F.col("_n") % 2 == 1)
    return ranges.groupBy("video_id", "_block").agg(F.collect_list(F.struct("start", "end", *what)).alias("_edits"))


def _with_edits(pose: DataFrame, edited: DataFrame) -> DataFrame:
    """pose with the _edits of its block, null where it has none."""
    return pose.withColumn("_block", _block(F.col("frame"))).join(edited, ["video_id", "_block"], "left").drop("_block")


def _here(e: Column) -> Column:
    return F.col("frame").between(e["start"], e["end"])


def delete_tracks(pose: DataFrame, edits: DataFrame) -> DataFrame:
    """Poses without the instances of the edits (video_id, start, end, instance, keypoint); a keypoint goes alone where one is named."""
    mine = F.filter("_edits", lambda e: _here(e) & (e["instance"] == F.col("instance")))
    j = _with_edits(pose, _edited(edits, "instance", "keypoint")).withColumn("_edits", mine)
    j = j.where(~F.coalesce(F.exists("_edits", lambda e: e["keypoint"].isNull()), F.lit(False)))
    none = F.lit(None).cast("double")
    gone = lambda i: F.coalesce(F.exists("_edits", lambda e: e["keypoint"] == i), F.lit(False))
    kps = F.transform("kps", lambda p, i: F.when(gone(i), F.struct(none.alias("x"), none.alias("y"), none.alias("conf"))).otherwise(p))
    return j.withColumn("kps", kps).drop("_edits")


def swap_tracks(pose: DataFrame, edits: DataFrame, one: int = 0, other: int = 1) -> DataFrame:
    """Two instances change places on the frames of the edits (video_id, start, end[, last]); an odd number of edits on a frame swaps it."""
    j = _with_edits(pose, _edited(edits, odd=True))
    new = F.when(F.col("instance") == one, F.lit(other)).when(F.col("instance") == other, F.lit(one)).otherwise(F.col("instance"))
    swapped = F.size(F.filter("_edits", _here)) % 2 == 1
    return j.withColumn("instance", F.when(swapped, new).otherwise(F.col("instance"))).drop("_edits")


def copy_poses(pose: DataFrame, edits: DataFrame) -> DataFrame:
    """Poses of (video_id, frame, instance) replace those of (to_frame, to_instance); a source that is absent changes nothing."""
    copied = pose.join(edits, P.KEYS).select("video_id", F.col("to_frame").alias("frame"), F.col("to_instance").alias("instance"), "kps")
    return pose.join(copied.select(*P.KEYS), P.KEYS, "left_anti").unionByName(copied)


def move_poses(pose: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (video_id, frame, instance, keypoint, dx, dy) move present keypoints, all of them where keypoint is null; a named keypoint that
    is absent is put at (dx, dy) with confidence 1, and keeps its confidence otherwise. They meet by frame, as ``pose.to_arrays`` deals and
    sorts poses, so those are neither moved nor sorted again."""
    e = edits.groupBy("video_id", "frame").agg(F.collect_list(F.struct("instance", "keypoint", "dx", "dy")).alias("_edits"))
    own = F.filter("_edits", lambda m: m["instance"] == F.col("instance"))

    def moved(p: Column, i: Column) -> Column:
        mine = F.filter("_edits", lambda m: m["keypoint"].isNull() & P.seen(p) | (m["keypoint"] == i))
        dx, dy = F.aggregate(mine, F.lit(0.0), lambda s, m: s + m["dx"]), F.aggregate(mine, F.lit(0.0), lambda s, m: s + m["dy"])
        x, y = F.coalesce(p["x"], F.lit(0.0)) + dx, F.coalesce(p["y"], F.lit(0.0)) + dy
        return F.when(F.size(mine) > 0, F.struct(x.alias("x"), y.alias("y"), F.coalesce(p["conf"], F.lit(1.0)).alias("conf"))).otherwise(p)

    j = pose.join(e, ["video_id", "frame"], "left").withColumn("_edits", own)
    return j.withColumn("kps", F.when(F.col("_edits").isNull(), F.col("kps")).otherwise(F.transform("kps", moved))).drop("_edits")


# --- frames for training ---

def complete_frames(filled: DataFrame, individuals: int, least: int = 1) -> DataFrame:
    """(video_id, frame, row) of the frames that hold every individual, in runs of ``least`` frames or more, numbered per video from 0.

    filled: long rows (video_id, instance, keypoint, frame, x, y, conf) of a dense grid, as ``pose.interpolated`` gives them.
    """
    here = filled.where("x is not null or y is not null or conf is not null").groupBy("video_id", "frame").agg(F.count_distinct("instance").alias("n"))
    spans = R.spans(here.where(F.col("n") == individuals)).where(F.col("end") - F.col("start") + 1 >= least)
    frames = spans.select("video_id", F.explode(F.sequence("start", "end")).alias("frame"))
    return frames.withColumn("row", (F.row_number().over(R.video()) - 1).cast("bigint"))
