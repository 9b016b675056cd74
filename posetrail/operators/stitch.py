"""A new layout of bouts: the frames of each label are drawn together where they are many, and short bouts go."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posetrail.operators import runs as R

#: Runs of an output batch.
BATCH_RUNS = 10_000


class Places:
    """Disjoint taken intervals of a segment, in order; looking up and adding one takes a binary search."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.rows: list[tuple[int, int, int]] = []  # start, end, label

    def taken(self, frame: int) -> bool:
        k = bisect_right(self.starts, frame) - 1
        return k >= 0 and self.rows[k][1] >= frame

    def free(self, start: int, end: int) -> bool:
        return not self.taken(start) and bisect_left(self.starts, start) == bisect_right(self.starts, end)

    def add(self, start: int, end: int, label: int) -> None:
        k = bisect_left(self.starts, start)
        self.starts.insert(k, start)
        self.rows.insert(k, (start, end, label))


class Segment:
    """One segment's clusters, given by size: each is placed about its centre, or a frame to the right where its first frame is taken; the
    others wait and fill the free frames by their centres. The state is the clusters, not the frames."""

    def __init__(self, frames: int, least: int):
        self.frames, self.least, self.places, self.waiting = frames, least, Places(), []

    def cluster(self, label: int, size: int, total: int) -> None:
        """``total`` is the sum of the cluster's places in the segment."""
        centre = (2 * total + size) // (2 * size)  # halves up
        end = min(centre + size // 2 - (size % 2 == 0), self.frames - 1)
        start = end - size + 1
        if size >= self.least:
            for shift in (0, 1) if self.places.taken(start) and not self.places.taken(end) else (0,):
                if end + shift < self.frames and self.places.free(start + shift, end + shift):
                    self.places.add(start + shift, end + shift, label)
                    return
        self.waiting.append((total / size, label, size))

    def layout(self) -> Iterator[list[int]]:
        """[start, end, label] of the runs, in order."""
        waiting, at = iter(sorted(self.waiting, key=lambda w: w[0])), 0
        label, left, last = 0, 0, None
        for start, end, own in [*self.places.rows, (self.frames, self.frames, None)]:
            while at < start:  # a gap
                if not left:
                    _, label, left = next(waiting)
                some = min(left, start - at)
                if last and last[2] == label:
                    last[1] += some
                else:
                    if last:
                        yield last
                    last = [at, at + some - 1, label]
                at, left = at + some, left - some
            if own is None:
                break
            if last and last[2] == own:
                last[1] = end
            else:
                if last:
                    yield last
                last = [start, end, own]
            at = end + 1
        if last:
            yield last

    def cleaned(self) -> Iterator[tuple[int, int, int]]:
        """Runs below the least length take the label before them; those at the start take the second run's."""
        held, before = None, None
        for start, end, label in self.layout():
            short = end - start + 1 < self.least
            if short and before is None and held is None:
                held = (start, end)
                continue
            if held:
                yield *held, label
                held, before = None, label
            if not short or before is None:
                before = label
            yield start, end, before
        if held:
            yield *held, label


def stitched(series: DataFrame, value: str, neutral: tuple[int, ...], eps: int = 5, least: int = 3) -> DataFrame:
    """series (video_id, frame, value) with the labels of each segment between neutral labels (or missing frames) laid out anew.

    In a segment of three frames or more, labels of fewer than three frames first take the label before them. Frames of a label at most
    ``eps`` apart are a cluster. Clusters of at least ``least`` frames take the place about their centre, smallest first; the others fill what is
    free, by their centres; last, runs shorter than ``least`` take the label before. Neutral frames, null labels and short segments stay.
    Runs come from blocks of frames; a segment's clusters, which are far fewer, stream through one task.
    """
    kept = series.where(~F.col(value).isin(*neutral)).select("video_id", "frame", F.col(value).alias("label"))
    whole = R.spans(kept).select("video_id", F.col("start").alias("first"), F.explode(F.sequence("start", "end")).alias("frame"))
    labels = kept.join(whole, ["video_id", "frame"]).withColumn("both", F.struct("first", "label"))  # a run ends with its segment
    runs = _common(R.runs(labels, "both").select("video_id", "both.first", "both.label", "start", F.col("length").alias("n")))

    own = Window.partitionBy("video_id", "first", "label").orderBy("at")
    apart = F.coalesce(F.col("at") - F.lag(F.col("at") + F.col("n") - 1).over(own) > eps, F.lit(True))
    clusters = runs.withColumn("apart", apart.cast("int")).withColumn("cluster", F.sum("apart").over(own))
    total = F.col("n") * F.col("at") + F.expr("n * (n - 1) div 2")
    clusters = clusters.groupBy("video_id", "first", "frames", "label", "cluster").agg(F.sum("n").alias("size"), F.sum(total).alias("total"), F.min("at").alias("at"))
    frames = _laid(clusters, least).select("video_id", F.explode(F.sequence("start", "end")).alias("frame"), F.col("label").cast(series.schema[value].dataType).alias("_new"))
    out = series.join(frames, ["video_id", "frame"], "left").withColumn(value, F.coalesce("_new", value))
    return out.select(*series.columns)


def _common(runs: DataFrame) -> DataFrame:
    """Runs of segments of three frames or more (first: the segment's first frame, at: the run's place in it). Labels of fewer than three frames
    there take the last common label before; at the start one such frame takes the next label, and several the larger of the first two."""
    segment = Window.partitionBy("video_id", "first")
    inside = segment.orderBy("start")
    r = runs.withColumns({
        "common": F.sum("n").over(Window.partitionBy("video_id", "first", "label")) >= 3, "frames": F.sum("n").over(segment), "k": F.row_number().over(inside),
    }).where("frames >= 3")
    r = r.withColumns({
        "label0": F.max(F.when(F.col("k") == 1, F.col("label"))).over(segment), "label1": F.max(F.when(F.col("k") == 2, F.col("label"))).over(segment),
        "n0": F.max(F.when(F.col("k") == 1, F.col("n"))).over(segment), "lead": F.coalesce(F.min(F.when(F.col("common"), F.col("start"))).over(segment) - F.col("first"), F.col("frames")),
        "before": F.last(F.when(F.col("common"), F.col("label")), ignorenulls=True).over(inside),
    })
    second = F.when(F.col("n0") > 1, F.col("label0")).otherwise(F.col("label1"))
    opening = F.when(F.col("lead") == 1, second).otherwise(F.greatest("label0", second))
    label = F.when(F.col("common"), F.col("label")).otherwise(F.coalesce("before", opening))
    return r.select("video_id", "first", "frames", (F.col("start") - F.col("first")).alias("at"), "n", label.alias("label"))


def _laid(clusters: DataFrame, least: int) -> DataFrame:
    """(video_id, start, end, label): the runs of each segment's new layout, from its clusters in order of size."""
    key = ["video_id", "first"]
    columns = [*key, "frames", *(F.col(c).cast("bigint").alias(c) for c in ("label", "size", "total"))]
    ordered = clusters.repartition(*key).sortWithinPartitions(*key, "size", "label", "at").select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, segment, out = None, None, []
        for batch in batches:
            for video, first, frames, label, size, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (video, first) != of:
                    if segment:
                        out += ((of[0], of[1] + s, of[1] + e, v) for s, e, v in segment.cleaned())
                    of, segment = (video, first), Segment(frames, least)
                segment.cluster(label, size, total)
                if len(out) >= BATCH_RUNS:
                    yield _batch(out)
                    out = []
        if segment:
            out += ((of[0], of[1] + s, of[1] + e, v) for s, e, v in segment.cleaned())
        if out:
            yield _batch(out)

    video = clusters.schema["video_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"video_id {video}, start bigint, end bigint, label bigint")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["video_id", "start", "end", "label"])
