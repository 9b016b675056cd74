"""Frames, segments, triplets and separation measures for identity learning."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posetrail.operators import pose as P
from posetrail.operators import runs as R

#: Frames that a task convolves at once, and rows of a tile of cosines.
BLOCK, TILE_ROWS = 8192, 512


def eligible_frames(pose: DataFrame, lengths: DataFrame, head: int, center: int, tail: int, ambiguous: DataFrame | None = None, apart: float = 0.5,
                    strict: float = 0.3, size: tuple[float, float] = (0.7, 2.0), parts: int = 6, twist: float = 90.0) -> DataFrame:
    """(video_id, frame, eligible, safe) of the frames with two animals.

    Eligible: their centroids are more than ``apart`` body lengths apart, neither is twisted, neither is out of size among these frames,
    each has ``parts`` keypoints or more, and the frame is not ambiguous. Safe frames make up segments: farther than ``apart``, or, where
    a video has ambiguous frames, farther than ``strict``.
    """
    p = P.with_centroid(pose.where(P.visible() > 0))
    two = p.groupBy("video_id", "frame").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("video_id", "frame")
    p = p.join(two, ["video_id", "frame"], "left_semi")
    odd = P.with_centroid(P.out_size(p, *size)).withColumn("bad", F.col("out") | P.out_rotation(head, center, tail, twist) | P.out_bodypart(parts))
    first, last = (lambda c: F.min_by(c, "instance")), (lambda c: F.max_by(c, "instance"))
    f = odd.groupBy("video_id", "frame").agg(F.max("bad").alias("bad"), F.hypot(last("cx") - first("cx"), last("cy") - first("cy")).alias("d"))
    f = f.join(lengths, "video_id")
    if ambiguous is None:
        f = f.withColumns({"doubt": F.lit(False), "any": F.lit(False)})
    else:
        a = ambiguous.select("video_id", "frame").distinct().withColumn("doubt", F.lit(True))
        some = a.select("video_id").distinct().withColumn("any", F.lit(True))
        f = f.join(a, ["video_id", "frame"], "left").join(some, "video_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("doubt", "any")})
    far = F.col("d") > apart * F.col("body_length")
    safe = F.when(F.col("any"), F.col("d") > strict * F.col("body_length")).otherwise(far)
    return f.select("video_id", "frame", (far & ~F.col("bad") & ~F.col("doubt")).alias("eligible"), safe.alias("safe"))


def segments(frames: DataFrame, chunk: int = 1000, share: float = 1.0, least: int = 10) -> DataFrame:
    """(video_id, start, segment, frame) of eligible frames: runs of safe frames are cut into chunks of ``chunk`` frames from their start; chunks
    of more than three eligible frames count, and of more than 11 an even sample of the share, ``least`` at least, is taken."""
    spans = R.spans(frames.where("safe")).withColumnRenamed("start", "s")
    cut = spans.select("video_id", "s", "end", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("end") - F.col("s")) / chunk))).alias("k"))
    cut = cut.select("video_id", (F.col("s") + F.col("k") * chunk).alias("start"), F.least(F.col("s") + (F.col("k") + 1) * chunk - 1, F.col("end")).alias("end"))
    held = cut.select("video_id", "start", F.explode(F.sequence("start", "end")).alias("frame")).join(frames.where("eligible").select("video_id", "frame"), ["video_id", "frame"])
    w = Window.partitionBy("video_id", "start")
    h = held.withColumns({"n": F.count(F.lit(1)).over(w), "r": F.row_number().over(w.orderBy("frame")) - 1}).where("n > 3")
    if share < 1:
        target = F.greatest(F.floor(F.col("n") * share), F.lit(least))
        steps = F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(target - 1, F.lit(1))), lambda i: F.floor(i * (F.col("n") - 1) / F.greatest(target - 1, F.lit(1))))
        h = h.where((F.col("n") <= 11) | F.array_contains(steps, F.col("r").cast("bigint")))
    rank = h.select("video_id", "start").distinct().withColumn("segment", (F.row_number().over(Window.partitionBy("video_id").orderBy("start")) - 1).cast("bigint"))
    return h.join(rank, ["video_id", "start"]).select("video_id", "start", "segment", "frame")


def _segment(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vec_ids ascending, motion ids, unit rows) of a segment."""
    table = table.sort_by("vec_id")
    x = np.array(table.column("embedding").to_pylist(), dtype=np.float64).reshape(table.num_rows, -1)
    z = np.sqrt((x * x).sum(axis=1))
    some = z > 0  # a zero vector has no cosine
    return table.column("vec_id").to_numpy()[some], table.column("motion_id").to_numpy()[some], x[some] / z[some, None]


def _tiles(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of the matrix of cosines, a tile at a time, to twelve places, so that equal vectors tie."""
    for k in range(0, len(x), TILE_ROWS):
        yield k, np.round(x[k : k + TILE_ROWS] @ x.T, 12)


def _pair_values(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cosines of same-id and of different-id pairs, each pair once."""
    same, other = [], []
    for k, s in _tiles(x):
        upper = np.arange(len(x)) > np.arange(k, k + len(s))[:, None]
        alike = ids[k : k + len(s), None] == ids
        same.append(s[upper & alike])
        other.append(s[upper & ~alike])
    none = np.zeros(0)
    return np.concatenate([none, *same]), np.concatenate([none, *other])


def pair_statistics(e: DataFrame) -> DataFrame:
    """(segment, same, n, mean, p30, p70) of the cosines of all pairs of rows (segment, vec_id, motion_id, embedding) of a segment.

    A segment, which its chunk of frames bounds, is one matrix product in tiles; only its statistics leave the task.
    """

    def measured(table: pa.Table) -> pa.Table:
        _, ids, x = _segment(table)
        rows = [(table.column("segment")[0].as_py(), same, len(v), float(v.mean()), *np.percentile(v, [30, 70]).tolist()) for same, v in zip((True, False), _pair_values(ids, x), strict=True) if len(v)]
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["segment", "same", "n", "mean", "p30", "p70"])

    rows = e.where("embedding is not null").select(F.col("segment").cast("bigint"), "vec_id", "motion_id", "embedding")
    return rows.groupBy("segment").applyInArrow(measured, "segment bigint, same boolean, n bigint, mean double, p30 double, p70 double")


def margins(e: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """((segment, pairs, margin, p30, p70, good), (weighted_margin)): the gap of the mean cosine of same-id and different-id pairs, p30 of the
    former and p70 of the latter; a segment is good from ``least`` on; the mean margin is weighted by pairs. Pairs count once."""
    of = lambda c, same: F.max(F.when(F.col("same") == same, F.col(c)))
    out = pair_statistics(e).groupBy("segment").agg(F.sum("n").alias("pairs"), (of("mean", True) - of("mean", False)).alias("margin"), of("p30", True).alias("p30"), of("p70", False).alias("p70"))
    out = out.withColumn("good", F.coalesce(F.col("margin") >= least, F.lit(False)))
    some = out.where("margin is not null")
    return out, some.agg((F.sum(F.col("margin") * F.col("pairs")) / F.sum("pairs")).alias("weighted_margin"))


def triplets(e: DataFrame, mode: str = "semihard", most: int = 5000, seed: int = 7) -> DataFrame:
    """(segment, anchor, positive, negative) of good segments: positives have the anchor's id and a cosine under the segment's p30 of such
    pairs, negatives the other id and one over p70 of those. hard takes the farthest positive and nearest negative, median the middle
    candidate in order of vec_id, semihard the one nearest to midway between threshold and extreme, random a seeded choice. A segment
    gives its first anchors up to its share of ``most``. Candidates are chosen inside the tiles of a segment's matrix of cosines."""
    if mode not in ("hard", "median", "semihard", "random"):
        raise ValueError(f"no such mode: {mode}")
    of, _ = margins(e, -2.0)
    count = of.where("good").count()
    quota = (most + 1) // max(count, 1) + 1

    def picked(s: np.ndarray, row: int, able: np.ndarray, end: float, bar: float) -> int:
        """The candidate of one anchor: ``able`` are places in order of vec_id, ``end`` the extreme cosine (1 for the least)."""
        v = s[able]
        if mode == "median":
            return able[len(able) // 2]
        if mode == "random":
            return able[int(np.random.default_rng((seed, row, len(able))).integers(len(able)))]
        extreme = v.min() if end > 0 else v.max()
        return able[int(np.argmin(end * v if mode == "hard" else np.round(np.abs(v - (bar + extreme) / 2), 12)))]

    def chosen(table: pa.Table) -> pa.Table:
        vec, ids, x = _segment(table)
        same, other = _pair_values(ids, x)
        rows: list[tuple] = []
        if len(same) and len(other):
            p30, p70 = np.percentile(same, 30), np.percentile(other, 70)
            for k, tile in _tiles(x):
                for i, s in enumerate(tile, k):
                    alike = ids == ids[i]
                    positive, negative = np.flatnonzero(alike & (s < p30) & (np.arange(len(s)) != i)), np.flatnonzero(~alike & (s > p70))
                    if len(positive) and len(negative) and len(rows) < quota:
                        rows.append((table.column("segment")[0].as_py(), int(vec[i]), int(vec[picked(s, int(vec[i]), positive, 1.0, p30)]), int(vec[picked(s, int(vec[i]), negative, -1.0, p70)])))
        return pa.table([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["segment", "anchor", "positive", "negative"])

    rows = e.where("embedding is not null").select(F.col("segment").cast("bigint"), F.col("vec_id").cast("bigint"), "motion_id", "embedding")
    return rows.groupBy("segment").applyInArrow(chosen, "segment bigint, anchor bigint, positive bigint, negative bigint")


# --- two peaks ---

def peaks(y: np.ndarray, prominence: float, distance: int) -> list[tuple[int, float]]:
    """(place, prominence) of local maxima: of those closer than ``distance`` the highest stays; then those of the prominence stay."""
    tops = []
    k = 1
    while k < len(y) - 1:
        if y[k - 1] < y[k]:
            end = k
            while end < len(y) - 1 and y[end + 1] == y[k]:
                end += 1
            if end < len(y) - 1 and y[end + 1] < y[k]:
                tops.append((k + end) // 2)
            k = end
        k += 1
    kept: list[int] = []
    for k in sorted(tops, key=lambda t: (-y[t], -t)):
        if all(abs(k - other) >= distance for other in kept):
            kept.append(k)
    out = []
    for k in sorted(kept):
        sides = []
        for step in (-1, 1):
            at, low = k, y[k]
            while 0 <= at < len(y) and y[at] <= y[k]:
                low = min(low, y[at])
                at += step
            sides.append(low)
        if (p := y[k] - max(sides)) >= prominence:
            out.append((k, float(p)))
    return out


def bimodality(values: DataFrame, column: str, bins: int = 8192, band: float = 0.2, depth: float = 0.9, off: float = 0.15, between: float = 0.15) -> dict[str, float | bool]:
    """Whether the values have two clear peaks: bimodal, score, valley_depth, peak_ratio, center_deviation.

    Spark counts ``bins`` bins, whose centres stand for their values; a Gaussian kernel of ``band`` standard deviations is laid over 1,000
    points from a tenth below to a tenth above the range. The two most prominent peaks (a quarter of the highest at least, 50 points
    apart) must lie ``between`` of the range apart; the valley must be deep and near the middle. Under 50 values: not bimodal.
    """
    none = {"bimodal": False, "score": 0.0, "valley_depth": 0.0, "peak_ratio": 0.0, "center_deviation": 1.0}
    some = values.select(F.col(column).cast("double").alias("v")).where("v is not null")
    n, low, high, std = some.agg(F.count("v"), F.min("v"), F.max("v"), F.stddev("v")).first()
    if n < 50 or not high > low:
        return none
    place = F.least(F.floor((F.col("v") - low) / ((high - low) / bins)), F.lit(bins - 1)).alias("bin")
    rows = some.groupBy(place).agg(F.avg("v").alias("centre"), F.count("v").alias("n")).orderBy("bin").collect()  # ``bins`` at most
    at, weight = np.array([r["centre"] for r in rows]), np.array([r["n"] for r in rows], dtype=float)
    x = np.linspace(low - 0.1 * (high - low), high + 0.1 * (high - low), 1000)
    width = band * std
    y = np.exp(-0.5 * ((x[:, None] - at) / width) ** 2) @ weight / (n * width * math.sqrt(2 * math.pi))
    found = sorted(peaks(y, 0.25 * y.max(), 50), key=lambda p: p[1])[-2:]
    if len(found) < 2:
        return none
    (i, _), (j, _) = sorted(found)
    if x[j] - x[i] < (high - low) * between:
        return none
    valley = i + int(np.argmin(y[i : j + 1]))
    deep = 1 - y[valley] / ((y[i] + y[j]) / 2 + 1e-6)
    deviation = abs(x[valley] - (x[i] + x[j]) / 2) / ((x[j] - x[i]) / 2)
    shape = {"valley_depth": float(deep), "center_deviation": float(deviation)}
    if deep < depth or deviation > off:
        return none | shape
    return shape | {"bimodal": True, "score": float(np.clip(0.7 * deep + 0.3 * (1 - deviation), 0, 1)), "peak_ratio": float(min(y[i], y[j]) / (max(y[i], y[j]) + 1e-6))}


def separation(distances: DataFrame, least: int = 100) -> dict[str, float | bool]:
    """The measures of ``bimodality`` over all distances (d0, d1) to two centres, confidence_cv (mean margin over its deviation), and whether
    training may stop: clearly bimodal, even, with sure margins, on ``least`` points or more."""
    found = bimodality(distances.select(F.explode(F.array("d0", "d1")).alias("distance")), "distance")
    n, mean, deviation = distances.agg(F.count(F.lit(1)), F.avg(F.abs(F.col("d0") - F.col("d1"))), F.stddev_pop(F.abs(F.col("d0") - F.col("d1")))).first()
    cv = mean / (deviation + 1e-6) if n else 0.0
    clear = found["bimodal"] and found["score"] > 0.9 and found["center_deviation"] < 0.1 and found["valley_depth"] > 0.8
    return found | {"confidence_cv": cv, "stop": bool(n >= least and clear and cv > 5)}


def smoothed(scores: DataFrame, grid: DataFrame, value: str, sigma: float = 40.0) -> DataFrame:
    """(video_id, frame, value) on every grid frame (consecutive frames of each video): linear between scored frames, edges held, then a Gaussian
    of four sigmas on each side, beyond the ends of the video its end values.

    A task convolves one block of frames; frames near its edges go to the neighbours too, once each.
    """
    reach = int(4 * sigma + 0.5)
    size = max(BLOCK, reach)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    line = R.interpolated(scores.select("video_id", "frame", value), grid.select("video_id", "frame"), (value,), ("video_id",)).where(F.col(value).isNotNull())
    own = F.floor(F.col("frame") / size)
    near = F.array(own, F.floor((F.col("frame") - reach) / size), F.floor((F.col("frame") + reach) / size))
    rows = line.select(F.col("video_id").cast("bigint"), F.col("frame").cast("bigint"), F.col(value).cast("double").alias("v"), F.explode(F.array_distinct(near)).alias("block"))

    def blurred(table: pa.Table) -> pa.Table:
        table = table.sort_by("frame")
        frame, v = table.column("frame").to_numpy(), table.column("v").to_numpy()
        core = np.flatnonzero(frame // size == table.column("block")[0].as_py())
        if not len(core):  # a neighbour without frames of its own
            return table.slice(0, 0).select(["video_id", "frame", "v"])
        left, right = reach - core[0], reach - (len(v) - 1 - core[-1])
        out = np.convolve(np.pad(v, (max(left, 0), max(right, 0)), mode="edge"), kernel, mode="valid")
        return pa.table([table.column("video_id").take(core), table.column("frame").take(core), pa.array(out[max(-left, 0) :][: len(core)])], names=["video_id", "frame", "v"])

    return rows.groupBy("video_id", "block").applyInArrow(blurred, "video_id bigint, frame bigint, v double").withColumnRenamed("v", value)
