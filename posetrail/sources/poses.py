"""Wide pose files: CSV with a frame or image column, three or four header rows, and a column per animal, keypoint and coordinate."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posetrail.operators import files as O
from posetrail.operators import pose as P
from posetrail.sources.projects import Project

#: First cells of header rows.
HEADERS = ("scorer", "individuals", "bodyparts", "coords")
WRITER = "machine-labeled"


def _rows(spark: SparkSession, path: str, columns: int) -> DataFrame:
    schema = ", ".join(f"_c{i} string" for i in range(columns))
    return spark.read.schema(schema).csv(path)


def _headers(spark: SparkSession, path: str) -> list[list[str]]:
    """The distinct header lines, in one pass over the text; more of them than one set raises."""
    lines = spark.read.text(path).where(F.col("value").rlike(f"^({'|'.join(HEADERS)}),")).select("value").distinct().limit(len(HEADERS) + 1).collect()
    heads = list(csv.reader(r["value"] for r in lines))
    if len(heads) != len({h[0] for h in heads}):
        raise ValueError(f"files of different columns at {path}")
    return heads


def read_poses(spark: SparkSession, path: str, project: Project) -> DataFrame:
    """(video_id, frame, instance, kps) of wide CSV files; files below folders ``video_id=...`` have that id, others 0.

    The frame is a number or, in files of labelled images, that of the image name in the first cell (or in the third, where the
    path is split over three). Columns are found by the header rows (individual, body part, coordinate), so files may order keypoints
    as they like; rows whose frame does not parse are left out. Without likelihoods the confidence is 1 where x and y are there.
    Negative values and empty cells are null; poses without any value are left out. A file that lacks a column of the project raises.
    """
    heads = {h[0]: h for h in _headers(spark, path)}
    width = max(map(len, heads.values()), default=0)
    if not width:
        raise ValueError(f"no header rows at {path}")
    rows = _rows(spark, path, width)
    if "video_id" not in rows.columns:
        rows = rows.withColumn("video_id", F.lit(0))
    animals = project.individuals or ("",)
    at: dict[tuple[int, int, str], int] = {}
    for i in range(1, width):
        name = heads["bodyparts"][i] if "bodyparts" in heads else None
        who = heads["individuals"][i] if "individuals" in heads else animals[0]
        if name in project.keypoints and (who in animals or "individuals" not in heads):
            at[animals.index(who) if who in animals else 0, project.keypoints.index(name), heads["coords"][i]] = i
    need = [(a, k, c) for a in range(len(animals)) for k in range(len(project.keypoints)) for c in ("x", "y")]
    if lost := [n for n in need if n not in at]:
        raise ValueError(f"{len(lost)} columns of the project are not in {path}, such as {lost[0]}")
    conf = all((a, k, "likelihood") in at for a, k, _ in need)
    value = lambda *n: F.expr(f"try_cast(_c{at[n]} as double)")
    good = lambda v: F.when(v >= 0, v)

    def point(a: int, k: int):
        x, y = good(value(a, k, "x")), good(value(a, k, "y"))
        c = good(value(a, k, "likelihood")) if conf else F.when(x.isNotNull() & y.isNotNull(), F.lit(1.0))
        return F.struct(x.alias("x"), y.alias("y"), c.alias("conf"))

    poses = F.array(*(F.struct(F.lit(a).alias("instance"), F.array(*(point(a, k) for k in range(len(project.keypoints)))).alias("kps")) for a in range(len(animals))))
    path_of = F.when(F.col("_c0") == "labeled-data", F.concat_ws("/", "_c0", "_c1", "_c2") if width > 2 else F.col("_c0")).otherwise(F.col("_c0"))
    frame = F.coalesce(F.expr("try_cast(try_cast(_c0 as double) as bigint)"), O.image_frame("_path"))
    out = rows.where(~F.col("_c0").isin(*HEADERS)).withColumn("_path", path_of).withColumn("frame", frame).where("frame is not null")
    out = out.select(F.col("video_id").cast("bigint").alias("video_id"), "frame", F.explode(poses).alias("p")).select("video_id", "frame", "p.instance", "p.kps")
    return out.where(F.exists("kps", lambda p: p["x"].isNotNull() | p["y"].isNotNull() | p["conf"].isNotNull()))


def header_lines(project: Project, conf: bool, scorer: str | None = WRITER) -> list[str]:
    """The header rows of a wide file, as lines."""
    parts = ("x", "y", "likelihood") if conf else ("x", "y")
    animals = project.individuals or tuple(str(k + 1) for k in range(project.animals))
    cells = [(a, k, c) for a in animals for k in project.keypoints for c in parts]
    out = [["scorer", *[scorer] * len(cells)]] if scorer else []
    out += [["individuals", *(a for a, _, _ in cells)]] if project.multi_animal or len(animals) > 1 else []
    out += [["bodyparts", *(k for _, k, _ in cells)], ["coords", *(c for _, _, c in cells)]]
    return [",".join(r) for r in out]


def write_poses(pose: DataFrame, path: str, project: Project, conf: bool = True, scorer: str | None = WRITER, images: str | None = None) -> None:
    """A wide CSV file for each video, in a folder ``video_id=...`` below path: header rows, then the frames in order, of repeated rows
    of a frame the first values. With ``images``, a folder's name, the first cell is the image path instead of the frame.

    A video is one file, so one task writes it, streaming its sorted lines.
    """
    names, animals = list(project.keypoints), project.animals
    wide = P.to_wide(pose, names, animals, conf)
    parts = ("x", "y", "conf") if conf else ("x", "y")
    cells = [F.coalesce(F.col(f"i{a}_{n}_{c}").cast("string"), F.lit("")) for a in range(animals) for n in names for c in parts]
    first = O.image_path(F.lit(images), F.col("frame")) if images else F.col("frame").cast("string")
    lines = wide.select("video_id", F.col("frame").alias("_at"), F.array_join(F.array(first, *cells), ",").alias("value"))
    heads = header_lines(project, conf, scorer)
    top = F.array(*(F.struct(F.lit(k - len(heads)).cast("bigint").alias("_at"), F.lit(h).alias("value")) for k, h in enumerate(heads)))
    head = wide.select("video_id").distinct().select("video_id", F.explode(top).alias("h")).select("video_id", "h._at", "h.value")
    ordered = head.union(lines).repartition("video_id").sortWithinPartitions("video_id", "_at")
    ordered.select("video_id", "value").write.mode("overwrite").partitionBy("video_id").text(path)


def reindexed(spark: SparkSession, path: str, project: Project) -> DataFrame:
    """A wide file as rows (video_id, frame, levels, scorer, and a column per animal, keypoint and coordinate) for Parquet.

    Where a video begins at frame 1, its first frame, lost for want of values, comes back with nulls. The scorer is the project's.
    ``levels`` are the parts of an image path, null for numbered frames.
    """
    wide = P.to_wide(read_poses(spark, path, project), list(project.keypoints), project.animals)
    lost = wide.groupBy("video_id").agg(F.min("frame").alias("frame")).where("frame = 1").select("video_id", F.lit(0).cast("bigint").alias("frame"))
    rows = _rows(spark, path, 3)
    images = rows.where(F.col("_c0").startswith("labeled-data"))
    images = images.withColumn("_path", F.when(F.col("_c0") == "labeled-data", F.concat_ws("/", "_c0", "_c1", "_c2")).otherwise(F.col("_c0")))
    video = F.col("video_id").cast("bigint") if "video_id" in rows.columns else F.lit(0).cast("bigint")
    levels = images.select(video.alias("video_id"), O.image_frame("_path").alias("frame"), O.path_levels("_path").alias("levels")).dropDuplicates(["video_id", "frame"])
    out = wide.unionByName(lost, allowMissingColumns=True).join(levels, ["video_id", "frame"], "left")
    return out.withColumn("scorer", F.lit(project.scorer))


def records(pose: DataFrame, project: Project) -> DataFrame:
    """(video_id, frame, values) with all animals' x, y and conf in one flat array, nulls for what is absent."""
    wide = P.to_wide(pose, list(project.keypoints), project.animals)
    cells = [F.col(f"i{a}_{n}_{c}") for a in range(project.animals) for n in project.keypoints for c in ("x", "y", "conf")]
    return wide.select("video_id", "frame", F.array(*cells).alias("values"))


def labelled_grid(labels: DataFrame, total: DataFrame, crops: DataFrame | None = None) -> DataFrame:
    """Sparse labels (video_id, path, instance, keypoint, x, y) on the dense grid of (video_id, total) frames: one row per frame, instance
    and keypoint that the video has, null where it is not labelled. Crop origins (video_id, frame, cx, cy) are added back."""
    long = O.labeled(labels, crops)
    kinds = long.select("video_id", "instance", "keypoint").distinct().join(total, "video_id")
    grid = kinds.select("video_id", "instance", "keypoint", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1)).alias("frame"))
    return grid.join(long, ["video_id", "frame", "instance", "keypoint"], "left").select("video_id", "frame", "instance", "keypoint", "x", "y")


def write_centres(track: DataFrame, path: str) -> None:
    """3D centres (video_id, instance, frame, x, y, z) with their sample ids, as Parquet: one folder per instance, and one of all."""
    w = Window.partitionBy("video_id", "instance").orderBy("frame")
    rows = track.withColumn("sample_id", (F.row_number().over(w) - 1).cast("bigint"))
    rows.write.mode("overwrite").partitionBy("instance").parquet(f"{path.rstrip('/')}/by_instance")
    both = rows.groupBy("video_id", "sample_id").agg(F.sort_array(F.collect_list(F.struct("instance", "x", "y", "z"))).alias("com"))
    both.write.mode("overwrite").parquet(f"{path.rstrip('/')}/all")


def write_diagnosis(timeline: DataFrame, path: str) -> None:
    """A CSV timeline with a header, (video_id, frame_index, ...) in order of range partitions."""
    timeline.repartitionByRange("video_id", "frame_index").sortWithinPartitions("video_id", "frame_index").write.mode("overwrite").csv(path, header=True)


def migrated(labels: DataFrame, roi: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Labelled poses of a project moved to its cropped images: of the listed frames, with each video's crop origin (video_id, x1, y1)
    taken from x and y, under their image paths."""
    chosen = labels if frames is None else labels.join(frames, ["video_id", "frame"], "left_semi")
    rows = P.to_long(P.crop_shift(chosen, roi, -1))
    return rows.withColumn("path", O.image_path(F.concat(F.lit("v"), F.col("video_id").cast("string")), F.col("frame")))

