"""Runs, spans, bouts, marks and joins over frame series. A window partition is one video, or one track of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posetrail.operators import scan
from posetrail.operators.lineage import cut

#: Frames of a block of the windows over a video.
BLOCK = 65_536
#: Rows of a track that the filter takes as one matrix product.
STEPS = 512


def video():
    """The frames of a video in order."""
    return Window.partitionBy("video_id").orderBy("frame")


def block() -> Column:
    """The block of a frame: windows within (video, block) let a long video's frames be shared by many tasks."""
    return F.floor(F.col("frame") / BLOCK)


def spans(frames: DataFrame) -> DataFrame:
    """Contiguous inclusive spans (video_id, start, end) of a set of frames."""
    f = frames.select("video_id", "frame").distinct().withColumn("_one", F.lit(1))
    return runs(f, "_one", by_gap=True).select("video_id", "start", "end")


def runs(series: DataFrame, value: str, by_gap: bool = False) -> DataFrame:
    """(video_id, start, end, value, length) of equal neighbours in frame order; with by_gap a missing frame ends a run.

    Runs are made within blocks of frames. The first and the last of a block, which may go on next door, are joined by a window over
    them alone: two rows a block; the others are done.
    """
    w = Window.partitionBy("video_id", "_block").orderBy("frame")
    s = series.select("video_id", "frame", value, block().alias("_block"))
    change = ~F.lag(value).over(w).eqNullSafe(F.col(value)) | F.lag("frame").over(w).isNull()
    if by_gap:
        change = change | (F.lag("frame").over(w) != F.col("frame") - 1)
    s = s.withColumn("_change", change.cast("int")).withColumn("_run", F.sum("_change").over(w))
    part = s.groupBy("video_id", "_block", "_run", value).agg(F.min("frame").alias("start"), F.max("frame").alias("end"), F.count(F.lit(1)).alias("length"))
    part = part.withColumn("_edge", (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(Window.partitionBy("video_id", "_block"))))
    edge = Window.partitionBy("video_id").orderBy("start")
    apart = ~F.lag(value).over(edge).eqNullSafe(F.col(value)) | F.lag("_block").over(edge).eqNullSafe(F.col("_block")) | F.lag("start").over(edge).isNull()
    if by_gap:
        apart = apart | (F.lag("end").over(edge) != F.col("start") - 1)
    e = part.where("_edge").withColumn("_change", apart.cast("int")).withColumn("_run", F.sum("_change").over(edge))
    e = e.groupBy("video_id", "_run", value).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("length").alias("length"))
    columns = ["video_id", value, "start", "end", "length"]
    return part.where(~F.col("_edge")).select(*columns).unionByName(e.select(*columns))


def changes(series: DataFrame, value: str, first: bool = False) -> DataFrame:
    """(video_id, frame) where the value differs from that of the frame before; with first the first frame counts."""
    before = F.lag(value).over(video())
    changed = (F.col("_before") != F.col(value)) | (F.col("_before").isNull() if first else F.lit(False))
    return series.withColumn("_before", before).where(changed).select("video_id", "frame")


def buffered(frames: DataFrame, b: int, last: DataFrame) -> DataFrame:
    """All frames within b of the given ones, clipped to 0 and each video's ``last``."""
    j = frames.join(last, "video_id")
    return j.select("video_id", F.explode(F.sequence(F.greatest(F.col("frame") - b, F.lit(0)), F.least(F.col("frame") + b, F.col("last")))).alias("frame")).distinct()


def backwards():
    """The frames of a video from the last; a running window over it looks ahead at linear cost."""
    return Window.partitionBy("video_id").orderBy(F.desc("frame"))


def next_change(series: DataFrame, value: str) -> DataFrame:
    """Column next: the next frame with a change after each frame, or the number of frames."""
    starts = runs(series, value).select("video_id", F.col("start").alias("frame"), F.col("start").alias("_start"))
    total = series.groupBy("video_id").agg((F.max("frame") + 1).alias("_total"))
    s = series.join(starts, ["video_id", "frame"], "left")
    s = scan.running(s, ["video_id"], ["frame"], block(), ahead={"next": (scan.MIN, F.col("_start"))}, exclusive=True)
    return s.join(total, "video_id").withColumn("next", F.coalesce("next", "_total")).select(*series.columns, "next")


def annotate_fill(series: DataFrame, edits: DataFrame, value: str = "label") -> DataFrame:
    """Each edit (video_id, frame, new) sets the label from its frame to the next change."""
    reach = next_change(series, value).join(edits, ["video_id", "frame"]).select("video_id", F.col("frame").alias("s"), F.col("next").alias("t"), "new")
    frames = reach.select("video_id", F.explode(F.sequence(F.col("s"), F.col("t") - 1)).alias("frame"), "new").groupBy("video_id", "frame").agg(F.max("new").alias("new"))
    return series.join(frames, ["video_id", "frame"], "left").withColumn(value, F.coalesce("new", value)).drop("new")


def bout_clusters(series: DataFrame, value: str, eps: int) -> DataFrame:
    """One-dimensional clusters per label: a gap over eps starts one. (video_id, label, cluster, size, centre)"""
    w = Window.partitionBy("video_id", value).orderBy("frame")
    s = series.withColumn("new", (F.coalesce(F.col("frame") - F.lag("frame").over(w) > eps, F.lit(True))).cast("int")).withColumn("cluster", F.sum("new").over(w))
    return s.groupBy("video_id", value, "cluster").agg(F.count(F.lit(1)).alias("size"), F.avg("frame").alias("centre"))


def nearest_marks(frames: DataFrame, marks: DataFrame) -> DataFrame:
    """Each frame with the marked frame before and after it (strictly); an as-of join by one window, without an inequality join."""
    m = marks.select("video_id", "frame", F.col("frame").alias("mark")).distinct()
    j = frames.join(m, ["video_id", "frame"], "left")
    return j.select(
        "video_id", "frame", F.last("mark", ignorenulls=True).over(video().rowsBetween(Window.unboundedPreceding, -1)).alias("previous"),
        F.last("mark", ignorenulls=True).over(backwards().rowsBetween(Window.unboundedPreceding, -1)).alias("following"),
    )


def last_nonempty(counts: DataFrame, value: str, back: int = 10) -> DataFrame:
    """The last frame with a value within ``back`` frames before each, else frame - 1."""
    w = video().rangeBetween(-back, -1)
    return counts.select("video_id", "frame", F.coalesce(F.last(F.when(F.col(value) > 0, F.col("frame")), ignorenulls=True).over(w), F.col("frame") - 1).alias("source"))


def interpolated(long: DataFrame, grid: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...], max_gap: int = 0, whole: tuple[str, ...] | None = None) -> DataFrame:
    """Linear values of the columns on every grid frame of each key, edges held; grid has (keys, frame).

    With max_gap, frames of gaps longer than it are nulled again, where ``whole`` (keys by default) have no value at all: a track
    of several keypoints, say, has a gap where all are absent. Values run forwards and backwards in blocks of frames.
    """
    g = grid.join(long.select(*keys, "frame", *columns), [*keys, "frame"], "left")
    place = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col("frame").alias("f"), F.col(c).alias("v")))
    back, ahead = ({f"_{way}_{c}": (scan.LAST, place(c)) for c in columns} for way in "ba")
    g = scan.running(g, list(keys), ["frame"], block(), back, ahead)
    out = []
    for c in columns:
        b, a = F.col(f"_b_{c}"), F.col(f"_a_{c}")
        line = b["v"] + (a["v"] - b["v"]) * (F.col("frame") - b["f"]) / (a["f"] - b["f"])
        out.append(F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.coalesce(line, b["v"], a["v"])).alias(c))
    filled = g.select(*keys, "frame", *out)
    if not max_gap:
        return filled
    whole = whole or keys
    absent = g.groupBy(*whole, "frame").agg(F.min(F.coalesce(*columns).isNull()).alias("absent")).where("absent")
    absent = absent.withColumn("_g", F.col("frame") - F.row_number().over(Window.partitionBy(*whole).orderBy("frame")))
    gaps = absent.groupBy(*whole, "_g").agg(F.min("frame").alias("start"), F.max("frame").alias("end")).where(F.col("end") - F.col("start") + 1 > max_gap)
    lost = gaps.select(*whole, F.explode(F.sequence("start", "end")).alias("frame"), F.lit(True).alias("_lost"))
    joined = filled.join(lost, [*whole, "frame"], "left")
    return joined.select(*keys, "frame", *(F.when(F.col("_lost").isNull(), F.col(c)).alias(c) for c in columns))


def evenly(frames: DataFrame, k: int) -> DataFrame:
    """k evenly spaced frames of each video's sorted frames (truncated steps); all of them if there are k at most."""
    n = F.count(F.lit(1)).over(Window.partitionBy("video_id"))
    f = frames.withColumn("n", n).withColumn("r", F.row_number().over(video()) - 1)
    f = f.withColumn("i", F.expr(f"(r * {max(k - 1, 1)} + n - 2) div greatest(n - 1, 1)"))  # the first step that may reach r
    return f.where((F.col("n") <= k) | (F.expr(f"i * (n - 1) div {max(k - 1, 1)} = r") & (F.col("i") < k))).select("video_id", "frame")


def chunks(frames: DataFrame, size: int) -> DataFrame:
    return frames.withColumn("chunk", F.floor((F.row_number().over(video()) - 1) / size))


def resolve(marks: DataFrame, priority: dict[str, int]) -> DataFrame:
    """One category per frame: the highest priority, of equal ones the later in the given order."""
    order = {c: (p, i) for i, (c, p) in enumerate(priority.items())}
    rank: Column = F.create_map(*(F.lit(x) for c, (p, i) in order.items() for x in (c, p * 1000 + i)))[F.col("category")]
    return marks.groupBy("video_id", "frame").agg(F.max_by("category", rank).alias("category"))


def apply_marks(old: DataFrame, new: DataFrame, mode: str, kept_out: DataFrame) -> DataFrame:
    """REPLACE, SUBSET or COMBINE the marked frames with new ones, less those kept out (labeled, rejected, approved)."""
    out = {"REPLACE": lambda: new, "SUBSET": lambda: old.join(new, ["video_id", "frame"], "left_semi"), "COMBINE": lambda: old.union(new)}[mode]()
    return out.distinct().join(kept_out, ["video_id", "frame"], "left_anti")


# --- steps that depend on the ones before ---

def short_bouts(series: DataFrame, value: str, least: int) -> DataFrame:
    """Inner bouts shorter than ``least`` take the longer neighbour's label (tie: the left one's) until none is short. (video_id, start, end, value)

    A pass goes by the lengths at its start. In it a bout sees its left neighbour as the pass has left it and its right one as it
    was, so a chain of bouts that look left takes the label of what stands before it: one window over the bouts of a video.
    """
    w = Window.partitionBy("video_id").orderBy("start")
    bouts = cut(runs(series, value).select("video_id", "start", "end", F.col(value).alias("v")))
    while True:
        n = F.col("end") - F.col("start") + 1
        b = bouts.withColumn("n", n).withColumns({"left": F.lag("n").over(w), "right": F.lead("n").over(w), "next": F.lead("v").over(w)})
        b = b.withColumn("short", (F.col("n") < least) & F.col("left").isNotNull() & F.col("right").isNotNull())
        if b.where("short").isEmpty():
            return bouts.select("video_id", "start", "end", F.col("v").alias(value))
        own = F.when(~F.col("short"), F.col("v")).when(F.col("left") < F.col("right"), F.col("next"))
        b = b.withColumn("v", F.last(own, ignorenulls=True).over(w)).select("video_id", "start", "end", "v")
        b = b.withColumn("r", F.sum(F.coalesce((F.lag("v").over(w) != F.col("v")).cast("int"), F.lit(1))).over(w))
        bouts = cut(b.groupBy("video_id", "r", "v").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("r"))


def _settled(series: DataFrame, value: str, on: int, buffer: int) -> DataFrame:
    """(video_id, frame, base, near): base is the value, in single-frame runs that of the last longer run before them (before all of
    those: of the video's last frame); near where the frame is within the buffer of a longer run of ``on``."""
    w, ahead = Window.partitionBy("video_id").orderBy("start"), Window.partitionBy("video_id").orderBy(F.desc("start"))
    r = runs(series, value).withColumnRenamed(value, "v")
    long = F.col("length") > 1
    held = long & (F.col("v") == on)
    last = F.last("v").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    r = r.withColumns({
        "reach": F.max(F.when(held, F.col("end") + buffer)).over(w), "next": F.min(F.when(held, F.col("start") - buffer)).over(ahead),
        "base": F.when(long, F.col("v")).otherwise(F.coalesce(F.last(F.when(long, F.col("v")), ignorenulls=True).over(w), last)),
        "before": F.last(F.when(long, F.col("end")), ignorenulls=True).over(w),
    })
    change = ~F.lag(value).over(video()).eqNullSafe(F.col(value)) | F.lag("frame").over(video()).isNull()
    frames = series.select("video_id", "frame", F.max(F.when(change, F.col("frame"))).over(video()).alias("start"))
    j = frames.join(r, ["video_id", "start"])
    near = F.coalesce(F.col("frame") <= F.col("reach"), F.lit(False)) | F.coalesce(F.col("frame") >= F.col("next"), F.lit(False))
    follows = ~long & F.coalesce(F.col("before") <= F.col("reach"), F.lit(False))  # a single run copies what the buffer has put before it
    return j.select("video_id", "frame", "base", near.alias("near"), follows.alias("follows"))


def blob_clean(counts: DataFrame, buffer: int = 5) -> DataFrame:
    """Counts clipped to 2; single-frame runs take the value before; longer runs of 2 and merged runs grow by the buffer; merged means 2.

    Frames are dense. Windows over the runs of a video replace the walk over its frames; a single run at the start takes the value of
    the video's last frame.
    """
    c = counts.select("video_id", "frame", F.least("animal_count", F.lit(2)).alias("c"), F.col("merged").cast("int").alias("m"))
    m = _settled(c, "m", 1, buffer).select("video_id", "frame", (F.col("near") | F.col("follows") | (F.col("base") == 1)).cast("int").alias("merged"))
    n = _settled(c, "c", 2, buffer).select("video_id", "frame", F.when(F.col("near"), 2).otherwise(F.col("base")).alias("animal_count"))
    j = n.join(m, ["video_id", "frame"])
    return j.select("video_id", "frame", F.when(F.col("merged") == 1, 2).otherwise(F.col("animal_count")).cast("int").alias("animal_count"), "merged")


def streamed(rows: DataFrame, keys: list[str], order: str, columns: list[str], make: Callable[[], Callable], ddl: str) -> DataFrame:
    """Each key's rows in order through ``make()``, a function of (values of the columns) with a state, called anew for each key; its
    tuples follow the key and order columns. Rows stream through a task in Arrow batches, so a key may have any number of them."""
    ordered = rows.select(*keys, order, *columns).repartition(*keys).sortWithinPartitions(*keys, order)
    names = [f.split()[0] for f in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step = None, None
        for batch in batches:
            table, out = [c.to_pylist() for c in batch.columns], []
            for *of, at in zip(*table[: len(keys) + 1], strict=True):
                if of != key:
                    key, step = of, make()
                out.append(step(at, *(c[len(out)] for c in table[len(keys) + 1 :])))
            made = [pa.array([o[k] for o in out]) for k in range(len(names) - len(keys) - 1)]
            head = list(batch.columns[: len(keys) + 1])
            schema = pa.schema([pa.field(n, t) for n, t in zip(names, types, strict=True)])
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip([*head, *made], types, strict=True)], schema=schema)

    types = [{"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}[f.split()[1]] for f in ddl.split(", ")]
    return ordered.mapInArrow(run, ddl)


class Filter:
    """The constant-velocity filter as a linear map of a block of STEPS steps: gains depend on the step alone, and blocks are alike once the
    covariance has settled. ``block(b)``: (positions by the block's inputs, positions by the state before it, state by inputs, state by state)."""

    def __init__(self, q: float, r: float, p0: float):
        self.q, self.r, self.begin, self.made = q, r, [(p0, 0.0, p0)], []

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        while len(self.made) <= b:
            if len(self.made) > 1 and np.allclose(self.begin[-1], self.begin[-2], rtol=1e-15, atol=0):
                return self.made[-1]
            self._add()
        return self.made[b]

    def _add(self) -> None:
        (a, b, d), first = self.begin[-1], not self.made
        of_inputs, of_state = np.zeros((2, STEPS)), np.eye(2)
        inputs, states = np.zeros((STEPS, 2, STEPS)), np.zeros((STEPS, 2, 2))
        for t in range(STEPS):
            a, b, d = a + 2 * b + d + self.q / 4, b + d + self.q / 2, d + self.q
            g, h = a / (a + self.r), b / (a + self.r)
            a, b, d = (1 - g) * a, (1 - g) * b, d - h * b
            move = np.array([[1 - g, 1 - g], [-h, 1 - h]])
            if first and t == 0:  # the filter starts at its first input, at rest
                move, g, h = np.zeros((2, 2)), 1.0, 0.0
            of_inputs, of_state = move @ of_inputs, move @ of_state
            of_inputs[:, t] += (g, h)
            inputs[t], states[t] = of_inputs, of_state
        self.begin.append((a, b, d))
        self.made.append((inputs[:, 0], states[:, 0], inputs, states))


def kalman(track: DataFrame, keys: tuple[str, ...] = ("video_id", "instance"), q: float = 0.8, r: float = 0.7, p0: float = 50.0) -> DataFrame:
    """Constant-velocity filter of each track's (x, y) in frame order: (keys, frame, x, y) after each update; rows without x or y are left out.

    The process noise is that of a constant acceleration over a frame. The axes do not meet and the gains do not depend on the data, so
    a block of a track's rows is an affine map of the state before it: a matrix product a block gives its end, the ends (a row each) are
    carried through a track in order, and a second product adds what the state before the block contributes.
    """
    some = track.where("x is not null and y is not null").select(*keys, F.col("frame").cast("bigint").alias("frame"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    steps = scan.running(some, list(keys), ["frame"], block(), {"step": (scan.COUNT, F.lit(1))}).withColumn("block", F.expr(f"(step - 1) div {STEPS}"))
    kinds = ", ".join(f"{k} {track.schema[k].dataType.simpleString()}" for k in keys)
    made: list[Filter] = []

    def maps(b: int) -> tuple[np.ndarray, ...]:
        if not made:
            made.append(Filter(q, r, p0))
        return made[0].block(b)

    def inputs(table: pa.Table) -> tuple[int, np.ndarray]:
        return table.column("block")[0].as_py(), np.column_stack([table.column(c).to_numpy() for c in "xy"])

    def ends(table: pa.Table) -> pa.Table:
        table = table.sort_by("frame")
        b, z = inputs(table)
        (x, y), (vx, vy) = maps(b)[2][len(z) - 1][:, : len(z)] @ z
        return pa.table([*(table.column(k)[:1] for k in (*keys, "block")), *(pa.array([v]) for v in (len(z), x, vx, y, vy))], names=[*keys, "block", "n", "ex", "evx", "ey", "evy"])

    def carried():
        state = {"s": np.zeros((2, 2))}

        def step(b, n, ex, evx, ey, evy):
            before = state["s"]
            state["s"] = maps(b)[3][n - 1] @ before + [[ex, ey], [evx, evy]]
            return tuple(before.ravel().tolist())

        return step

    def filtered(table: pa.Table) -> pa.Table:
        table = table.sort_by("frame")
        b, z = inputs(table)
        of_inputs, of_state, *_ = maps(b)
        start = np.array([[table.column(c)[0].as_py() for c in names] for names in (("sx", "sy"), ("svx", "svy"))])
        out = of_inputs[: len(z), : len(z)] @ z + of_state[: len(z)] @ start
        return pa.table([*(table.column(k) for k in (*keys, "frame")), *(pa.array(v) for v in out.T)], names=[*keys, "frame", "x", "y"])

    last = steps.groupBy(*keys, "block").applyInArrow(ends, f"{kinds}, block bigint, n bigint, ex double, evx double, ey double, evy double")
    starts = streamed(last, list(keys), "block", ["n", "ex", "evx", "ey", "evy"], carried, f"{kinds}, block bigint, sx double, sy double, svx double, svy double")
    whole = steps.join(starts, [*keys, "block"]).select(*keys, "block", "frame", "x", "y", "sx", "sy", "svx", "svy")
    return whole.groupBy(*keys, "block").applyInArrow(filtered, f"{kinds}, frame bigint, x double, y double")
