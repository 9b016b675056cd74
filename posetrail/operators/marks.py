"""Frame categories (video_id, frame, category), review decisions, overlays and combined masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posetrail.operators import pose as P
from posetrail.operators import runs as R

FRAME = ["video_id", "frame"]
#: Categories that get a second chance as "marked" when they are cleared.
SECOND_CHANCE = ("rejected", "approved")


def move(marks: DataFrame, new: str, old: str, frames: DataFrame | None = None) -> DataFrame:
    """The frames of ``old``, or those of them that are listed, become ``new``; a frame has a category once."""
    if frames is None:
        here = F.col("category") == old
        return marks.withColumn("category", F.when(here, F.lit(new)).otherwise(F.col("category"))).distinct()
    j = marks.join(frames.select(FRAME).distinct().withColumn("_here", F.lit(True)), FRAME, "left")
    here = (F.col("category") == old) & F.coalesce("_here", F.lit(False))
    return j.select(*FRAME, F.when(here, F.lit(new)).otherwise(F.col("category")).alias("category")).distinct()


def clear(marks: DataFrame, categories: list[str]) -> DataFrame:
    """Without the categories; the frames of rejected and approved ones are marked instead."""
    again = F.col("category").isin(*[c for c in categories if c in SECOND_CHANCE]) if set(categories) & set(SECOND_CHANCE) else F.lit(False)
    gone = F.col("category").isin(*categories) & ~again
    return marks.where(~gone).withColumn("category", F.when(again, F.lit("marked")).otherwise(F.col("category"))).distinct()


def clear_group(marks: DataFrame, groups: dict[str, str], group: str) -> DataFrame:
    """``clear`` for all categories of a group, given each category's group."""
    return clear(marks, [c for c, g in groups.items() if g == group])


def switch_view(marks: DataFrame) -> DataFrame:
    """On the way to labelling, rejected and approved frames are marked again."""
    return clear(marks, ["rejected", "approved"])


def toggle(marks: DataFrame, frames: DataFrame, view: tuple[str, ...] = ("marked", "rejected", "approved", "refined", "labeled")) -> DataFrame:
    """One step on each listed frame: labeled becomes refined; else refined becomes marked; else a frame of none of the view's categories
    is marked, and one that is marked, rejected or approved is so no more."""
    listed = frames.select(FRAME).distinct()
    of = listed.join(marks, FRAME, "left").groupBy(*FRAME).agg(*(F.max((F.col("category") == c).cast("int")).alias(c) for c in ("labeled", "refined")), F.max(F.col("category").isin(*view).cast("int")).alias("_any"))
    of = of.fillna(0, ["labeled", "refined", "_any"])
    j = marks.join(of, FRAME, "left")
    c, on = F.col("category"), F.col("_any").isNotNull()
    first = on & (F.col("labeled") == 1)
    second = on & ~first & (F.col("refined") == 1)
    third = on & ~first & ~second
    new = F.when(first & (c == "labeled"), "refined").when(second & (c == "refined"), "marked").otherwise(c)
    kept = j.where(F.coalesce(~(third & c.isin("marked", "rejected", "approved")), F.lit(True))).select(*FRAME, new.alias("category"))
    added = of.where("labeled = 0 and refined = 0 and _any = 0").select(*FRAME, F.lit("marked").alias("category"))
    return kept.union(added).distinct()


def reviewed(old: DataFrame, new: DataFrame, decisions: DataFrame) -> DataFrame:
    """Poses after a review: frames with status 1 take the new poses, those with 2 (rejected), 0 (open) and all others keep the old ones."""
    approved = decisions.where("status = 1").select(FRAME)
    return old.join(approved, FRAME, "left_anti").unionByName(new.join(approved, FRAME, "left_semi"))


def review_marks(marks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Categories after a review: decided frames are approved or rejected and no longer marked."""
    done = decisions.where("status in (1, 2)").select(*FRAME, F.when(F.col("status") == 1, "approved").otherwise("rejected").alias("category"))
    rest = marks.join(done.select(*FRAME, F.lit("marked").alias("category")), [*FRAME, "category"], "left_anti")
    return rest.union(done).distinct()


def overlay(pred: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled poses instead of the predicted ones on the frames that have any label."""
    some = labels.where(P.visible() > 0).select(FRAME).distinct()
    return pred.join(some, FRAME, "left_anti").unionByName(labels.join(some, FRAME, "left_semi"))


def overlay_marks(marks: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled frames are exactly those with labels, and are not marked, rejected, refined or approved."""
    some = labels.where(P.visible() > 0).select(FRAME).distinct()
    rest = marks.where("category <> 'labeled'").join(some, FRAME, "left")
    gone = marks.where(F.col("category").isin("marked", "rejected", "refined", "approved")).join(some, FRAME, "left_semi")
    return rest.join(gone, [*FRAME, "category"], "left_anti").union(some.withColumn("category", F.lit("labeled"))).distinct()


def saved_labels(labels: DataFrame, pred: DataFrame, refined: DataFrame) -> DataFrame:
    """Labels to save: those of refined frames come from the predictions, the others stay; their frames are the union."""
    r = refined.select(FRAME).distinct()
    return labels.where(P.visible() > 0).join(r, FRAME, "left_anti").unionByName(pred.join(r, FRAME, "left_semi"))


def remapped(new: DataFrame, frames: DataFrame, crop: DataFrame | None = None) -> DataFrame:
    """Poses of a second inference (video_id, position, instance, kps) on the frames that it was given, (video_id, frame) in order; the crop
    origin (video_id, x1, y1) is added. A frame beyond the new rows has one row with a null instance."""
    listed = frames.select(FRAME).distinct().withColumn("position", (F.row_number().over(R.video()) - 1).cast("bigint"))
    j = listed.join(new, ["video_id", "position"], "left").select(*FRAME, "instance", "kps")
    return j if crop is None else P.crop_shift(j, crop)


def combined(masks: list[DataFrame], every: bool = False, frames: DataFrame | None = None) -> DataFrame:
    """(keys) of poses that any (or every) mask, a table of keys, flags; with ``frames`` on these alone."""
    rows = reduce(DataFrame.unionByName, [m.select(*P.KEYS).distinct().withColumn("_m", F.lit(i)) for i, m in enumerate(masks)])
    out = rows.groupBy(*P.KEYS).agg(F.count_distinct("_m").alias("n")).where(F.col("n") >= (len(masks) if every else 1)).select(*P.KEYS)
    return out if frames is None else out.join(frames.select(FRAME).distinct(), FRAME, "left_semi")


def bout_names(runs: DataFrame, names: dict[int, str], label: str = "label", without: tuple[int, ...] = (255,)) -> DataFrame:
    """(video_id, category, start, end) of runs: codes by name, unknown ones as Unknown(n); excluded codes have none."""
    known: Column = F.create_map(*(x for k, v in names.items() for x in (F.lit(k), F.lit(v))))
    name = F.coalesce(F.get(F.transform(F.array(F.col(label)), lambda c: F.try_element_at(known, c)), F.lit(0)), F.concat(F.lit("Unknown("), F.col(label).cast("string"), F.lit(")")))
    return runs.where(~F.col(label).isin(*without)).select("video_id", name.alias("category"), "start", "end")


def composition(before: DataFrame, after: DataFrame, label: str = "label") -> DataFrame:
    """(label, before, after, delta) in percent of the rows on each side; a label that is absent from a side has 0 there."""
    share = lambda t, n: t.groupBy(label).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(t.agg(F.count(F.lit(1)).alias("total")))).select(label, (100 * F.col("n") / F.col("total")).alias(n))
    j = share(before, "before").join(share(after, "after"), label, "full").fillna(0.0, ["before", "after"])
    return j.select(label, "before", "after", (F.col("after") - F.col("before")).alias("delta"))
