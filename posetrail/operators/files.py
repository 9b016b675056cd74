"""Names, paths, notes and edits: labelled images, crop notes, prediction files, catalogues, gaps and spans. Nulls that do not parse stay null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posetrail.operators import runs as R

PROJECT_START = "1992-01-01"


# --- names and paths ---

def image_path(folder: Column, frame: Column) -> Column:
    return F.concat(F.lit("labeled-data/"), folder, F.lit("/img"), F.lpad(frame.cast("string"), 8, "0"), F.lit(".png"))


def image_frame(path: str) -> Column:
    """Frame id from an image name, null if the name has none."""
    return F.expr(f"try_cast(nullif(regexp_extract({path}, 'img([0-9]+)[.]png$', 1), '') as bigint)")


def path_levels(path: str) -> Column:
    """Levels of a path that is written with slashes or backslashes."""
    return F.split(path, r"[/\\]")


def normal_name(name: str) -> Column:
    """Lower case, letters and digits only."""
    return F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))


def integers(text: str) -> Column:
    """Integers of a text that commas, blanks or newlines part; other pieces are left out."""
    return F.filter(F.transform(F.split(text, r"[,\s]+"), lambda v: v.try_cast("bigint")), lambda v: v.isNotNull())


def prediction_name(path: str, pattern: str) -> tuple[Column, Column]:
    """(video, params): the two groups of the pattern, null where the name does not match."""
    return tuple(F.nullif(F.regexp_extract(path, pattern, k), F.lit("")) for k in (1, 2))


def day_number(day: str, start: str = PROJECT_START) -> Column:
    """Days of a yyyyMMdd text since the start, plus 1; 1 where it is no day."""
    return F.coalesce(F.datediff(F.try_to_timestamp(F.col(day), F.lit("yyyyMMdd")).cast("date"), F.lit(start).cast("date")) + 1, F.lit(1))


# --- labelled images and notes ---

def labeled(rows: DataFrame, crops: DataFrame | None = None) -> DataFrame:
    """Rows (video_id, path, ..., x, y) with their frame instead of the path; the crop origin of (video_id, frame, cx, cy) is added back."""
    out = rows.withColumn("frame", image_frame("path")).drop("path").where(F.col("frame").isNotNull())
    if crops is None:
        return out
    j = out.join(crops, ["video_id", "frame"], "left")
    return j.withColumn("x", F.col("x") + F.coalesce("cx", F.lit(0.0))).withColumn("y", F.col("y") + F.coalesce("cy", F.lit(0.0))).drop("cx", "cy")


def crop_notes(frames: DataFrame) -> DataFrame:
    """One note (video_id, x, y, sorted frames) for each crop origin."""
    return frames.groupBy("video_id", "x", "y").agg(F.sort_array(F.collect_set("frame")).alias("frames"))


def noted_frames(notes: DataFrame) -> DataFrame:
    return notes.select("video_id", "x", "y", F.explode("frames").alias("frame"))


def newest(files: DataFrame) -> DataFrame:
    """The newest file (video, path) of each video; of equal times the last path."""
    return files.groupBy("video").agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))


def missing(listed: DataFrame, present: DataFrame) -> DataFrame:
    """(video_id, frame, what): listed frames that are absent, and present ones that are not listed."""
    key = ["video_id", "frame"]
    a, b = listed.select(key).distinct(), present.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("what", F.lit("absent")).union(b.join(a, key, "left_anti").withColumn("what", F.lit("unlisted")))


# --- samples and edits ---

def random_frames(frames: DataFrame, n: int, seed: int) -> DataFrame:
    """n frames of each video in the order of a seeded hash of the frame: repeatable, without replacement."""
    order = (F.col("frame") * 2654435761 + seed) % 4294967296
    w = Window.partitionBy("video_id").orderBy(order, "frame")
    return frames.select("video_id", "frame").distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def swap_camera(pose: DataFrame, cam: int, start: int, end: int) -> DataFrame:
    """Swap the two instances on one camera within [start, end]."""
    here = (F.col("cam") == cam) & F.col("frame").between(start, end)
    return pose.withColumn("instance", F.when(here, 1 - F.col("instance")).otherwise(F.col("instance")))


def fill_gap(track: DataFrame, gaps: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Linear rows for each gap (video_id, instance, start, end) between the frames that bound it; a gap with one bound gives none.

    Gaps are an edit table, small beside the track; the bounds are two aggregates per gap.
    """
    key = ["video_id", "instance", "start", "end"]
    row = F.struct("frame", *columns)
    bound = track.join(gaps, key[:2]).groupBy(*key).agg(
        F.max(F.when(F.col("frame") < F.col("start"), row)).alias("a"), F.min(F.when(F.col("frame") > F.col("end"), row)).alias("b")
    ).where("a is not null and b is not null")
    out = bound.select(*key[:2], "a", "b", F.explode(F.sequence("start", "end")).alias("frame"))
    part = (F.col("frame") - F.col("a.frame")) / (F.col("b.frame") - F.col("a.frame"))
    return out.select(*key[:2], "frame", *((F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * part).alias(c) for c in columns))


def apply_spans(pose: DataFrame, spans: DataFrame, least: int = 4, ambiguous: DataFrame | None = None) -> DataFrame:
    """Swap the two instances on every frame of the spans that hold ``least`` frames.

    With ambiguous frames (video_id, frame), as under an id lock, a span that holds some is swapped from the first of them to its end,
    however long it is. Both tables are small beside the poses.
    """
    s = spans.select("video_id", "start", "end")
    if ambiguous is not None:
        inside = s.join(ambiguous.select("video_id", "frame").distinct(), "video_id").where(F.col("frame").between(F.col("start"), F.col("end")))
        first = inside.groupBy("video_id", "start", "end").agg(F.min("frame").alias("_first"))
        s = s.join(first, ["video_id", "start", "end"], "left")
        s = s.where(F.col("_first").isNotNull() | (F.col("end") - F.col("start") + 1 >= least)).select("video_id", F.coalesce("_first", "start").alias("start"), "end")
    else:
        s = s.where(F.col("end") - F.col("start") + 1 >= least)
    frames = s.select("video_id", F.explode(F.sequence("start", "end")).alias("frame")).distinct()
    j = pose.join(frames.withColumn("swap", F.lit(True)), ["video_id", "frame"], "left")
    return j.withColumn("instance", F.when(F.col("swap"), 1 - F.col("instance")).otherwise(F.col("instance"))).drop("swap")


def assign_cost(old: DataFrame, new: DataFrame) -> DataFrame:
    """(video_id, frame, cost): the lesser summed distance of the two ways to pair two animals; a missing distance counts 1e6."""
    wide = lambda t, n: t.groupBy("video_id", "frame").agg(*(F.max(F.when(F.col("instance") == i, F.col(c))).alias(f"{n}{i}{c}") for i in (0, 1) for c in ("cx", "cy")))
    j = wide(old, "o").join(wide(new, "n"), ["video_id", "frame"])
    dist = lambda a, b: F.coalesce(F.hypot(F.col(f"o{a}cx") - F.col(f"n{b}cx"), F.col(f"o{a}cy") - F.col(f"n{b}cy")), F.lit(1e6))
    return j.select("video_id", "frame", F.least(dist(0, 0) + dist(1, 1), dist(0, 1) + dist(1, 0)).alias("cost"))


def bearings(points: DataFrame) -> DataFrame:
    """Elevation and azimuth, in degrees, of (x, y, z) seen from the origin."""
    return points.withColumn("elevation", F.degrees(F.atan2("z", F.hypot("x", "y")))).withColumn("azimuth", F.degrees(F.atan2("y", "x")))


def centre_track(long: DataFrame, keypoint: int, grid: DataFrame) -> DataFrame:
    """One keypoint as the 3D centre of each instance on every grid frame, linear between known frames, edges held."""
    track = long.where(F.col("keypoint") == keypoint).select("video_id", "instance", "frame", "x", "y", "z")
    return R.interpolated(track, grid, ("x", "y", "z"), ("video_id", "instance"))


# fixed values: words of head and tail keypoint names, in order of priority
HEAD_NAMES = ("nose", "head", "forehead", "front", "snout", "face", "mouth", "muzzle", "spinF", "neck", "eye", "ear", "cheek", "chin", "anterior")
TAIL_NAMES = ("tailbase", "base_tail", "tail_base", "butt", "hip", "rump", "thorax", "ass", "pelvis", "tail", "spineM", "cent", "posterior", "back")


def first_named(names: str, words: tuple[str, ...]) -> Column:
    """Index of the first name that holds the earliest word, both by letters and digits alone; null if no word is found."""
    plain = F.transform(names, lambda n: F.lower(F.regexp_replace(n, "[^A-Za-z0-9]", "")))
    keys = ["".join(c for c in w.lower() if c.isalnum()) for w in words]
    place = lambda w: F.array_position(F.transform(plain, lambda n: n.contains(w)), F.lit(True))
    return F.coalesce(*(F.nullif(place(w), F.lit(0)) - 1 for w in keys)).cast("int")
