"""Queries over names, notes, files and edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from posetrail.operators import files as O
from posetrail.operators import identity as I
from posetrail.plans import fixtures as X
from posetrail.plans.identity_queries import CENTRES, Z, centres
from posetrail.plans.pose_queries import KEYS, R6, L
from posetrail.plans.registry import query
from posetrail.plans.series_queries import NAMES, annot, blob


def images(spark, d):
    long = X.pose_long(spark, d)
    return long.withColumn("path", O.image_path(F.concat(F.lit("v"), F.col("video_id")), F.col("frame"))).drop("frame")


@query("src_frame_list", f"{L} select distinct video_id, frame from pose_long")
def src_frame_list(spark, d):
    return O.labeled(images(spark, d)).select("video_id", "frame").distinct()


def crops(b):
    return O.crop_notes(b.select("video_id", "frame", (F.col("animal_count") * 40).alias("x"), (F.col("merged") * 10).alias("y")))


blob("snk_crop_notes", lambda b: crops(b).select("video_id", "x", "y", F.array_join("frames", ",").alias("frames")), " select video_id, animal_count * 40 x, merged * 10 y, string_agg(cast(frame as varchar), ',' order by frame) frames from blobs group by all")
blob("src_crop_notes", lambda b: O.noted_frames(crops(b)), " select distinct video_id, animal_count * 40 x, merged * 10 y, frame from blobs")
annot("join_missing_images", lambda a: O.missing(a.where("label = 1"), a.where("frame % 3 = 0")), " select video_id, frame, case when label = 1 then 'absent' else 'unlisted' end what from annot where (label = 1) <> (frame % 3 = 0)")
annot("smp_random", lambda a: O.random_frames(a, 10, 7), " select video_id, frame from (select video_id, frame, row_number() over (partition by video_id order by (frame * 2654435761 + 7) % 4294967296, frame) r from annot) where r <= 10")
annot("scl_map_invert", lambda a: a.withColumn("keys", F.create_map(*(x for i, n in enumerate(NAMES) for x in (F.lit(n), F.lit(i))))).select("video_id", "frame", F.map_from_arrays(F.map_values("keys"), F.map_keys("keys"))[F.col("label")].alias("name")), " select video_id, frame, case label when 0 then 'other' when 1 then 'click' when 2 then 'error' when 3 then 'purchase' else 'signup' end as name from annot")
annot("scl_norm_name", lambda a: a.select("video_id", "frame", F.concat(F.lit("Ear_"), F.col("label").cast("string"), F.lit(" (L)")).alias("n")).select("video_id", "frame", O.normal_name("n").alias("name")), " select video_id, frame, 'ear' || label || 'l' as name from annot")
annot("scl_path_levels", lambda a: a.select("video_id", "frame", O.image_path(F.concat(F.lit("v"), F.col("video_id")), F.col("frame")).alias("p")).select("video_id", "frame", F.element_at(O.path_levels("p"), 2).alias("folder"), F.element_at(O.path_levels("p"), -1).alias("image")), " select video_id, frame, 'v' || video_id as folder, 'img' || lpad(cast(frame as varchar), 8, '0') || '.png' as image from annot")
annot("scl_int_list", lambda a: a.select("video_id", "frame", F.concat_ws(", ", F.col("frame").cast("string"), F.lit("x"), F.col("label").cast("string")).alias("t")).select("video_id", "frame", F.explode(O.integers("t")).alias("v")), " select video_id, frame, frame as v from annot union all select video_id, frame, cast(label as bigint) from annot")

FILES = "files as (select 'v' || (o_custkey % 100) as video, 'p' || (o_orderkey % 3) as params, 'v' || (o_custkey % 100) || '_p' || (o_orderkey % 3) || '_' || o_orderkey || '.csv' as path, o_orderdate as mtime from orders)"


def files(spark, d):
    """Prediction files, named after a video, model parameters and a number; video and params are parsed from the name."""
    o = X.read(spark, d, "orders").selectExpr("concat('v', o_custkey % 100, '_p', o_orderkey % 3, '_', o_orderkey, '.csv') path", "o_orderdate mtime")
    video, params = O.prediction_name("path", r"^(v\d+)_(p\d+)_\d+\.csv$")
    return o.select(video.alias("video"), params.alias("params"), "path", "mtime")


query("scl_pred_name", f"with {FILES} select path, video, params from files")(lambda spark, d: files(spark, d).select("path", "video", "params"))
query("top_newest", f"with {FILES} select video, path from (select *, row_number() over (partition by video order by mtime desc, path desc) r from files) where r = 1")(lambda spark, d: O.newest(files(spark, d)))
query("top_keep_latest", f"with {FILES} select path, row_number() over (partition by video, params order by mtime desc, path desc) <= 2 as keep from files")(lambda spark, d: I.keep_newest(files(spark, d), 2).select("path", "keep"))


@query("scl_day_num", "select o_orderkey, cast(date_diff('day', date '1992-01-01', cast(o_orderdate as date)) + 1 as integer) as day_num from orders")
def day_num(spark, d):
    o = X.read(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("day"))
    return o.select("o_orderkey", O.day_number("day").alias("day_num"))


@query("trk_swap_cam", f"{L} select video_id, frame, cast(cam as integer) cam, cast(case when cam = 1 and frame between 100 and 200 then 1 - instance else instance end as integer) instance, keypoint, x, y from pose_long, generate_series(0, 2) t(cam)")
def swap_cam(spark, d):
    p = X.pose_long(spark, d).withColumn("cam", F.explode(F.array(*map(F.lit, range(3)))))
    return O.swap_camera(p, 1, 100, 200).select("video_id", "frame", "cam", "instance", "keypoint", "x", "y")


@query("trk_interp_gap", f"""{CENTRES}, b as (select video_id, instance, max(frame) filter (where frame < 500) f0, min(frame) filter (where frame > 510) f1 from inst group by all),
e as (select b.video_id, b.instance, f0, f1, p.cx x0, p.cy y0, q.cx x1, q.cy y1 from b join inst p on p.video_id = b.video_id and p.instance = b.instance and p.frame = f0 join inst q on q.video_id = b.video_id and q.instance = b.instance and q.frame = f1)
select video_id, instance, cast(f as bigint) frame, round(x0 + (x1 - x0) * (f - f0) / (f1 - f0), 6) cx, round(y0 + (y1 - y0) * (f - f0) / (f1 - f0), 6) cy from e, generate_series(500, 510) t(f)""")
def interp_gap(spark, d):
    c = centres(spark, d)
    gaps = c.select("video_id", "instance").distinct().select("video_id", "instance", F.lit(500).cast("bigint").alias("start"), F.lit(510).cast("bigint").alias("end"))
    return O.fill_gap(c.where("frame not between 500 and 510"), gaps, ("cx", "cy")).select("video_id", "instance", "frame", R6("cx"), R6("cy"))


@query("idt_assign_cost", f"""{CENTRES}, o as (select video_id, frame, max(cx) filter (where instance = 0) x0, max(cy) filter (where instance = 0) y0, max(cx) filter (where instance = 1) x1, max(cy) filter (where instance = 1) y1 from inst group by all)
select a.video_id, b.frame, round(least(coalesce(sqrt((a.x0 - b.x0) ** 2 + (a.y0 - b.y0) ** 2), 1e6) + coalesce(sqrt((a.x1 - b.x1) ** 2 + (a.y1 - b.y1) ** 2), 1e6), coalesce(sqrt((a.x0 - b.x1) ** 2 + (a.y0 - b.y1) ** 2), 1e6) + coalesce(sqrt((a.x1 - b.x0) ** 2 + (a.y1 - b.y0) ** 2), 1e6)), 6) cost from o a join o b on a.video_id = b.video_id and b.frame = a.frame + 1""")
def cost(spark, d):
    c = centres(spark, d)
    return O.assign_cost(c.withColumn("frame", F.col("frame") + 1), c).select("video_id", "frame", R6("cost"))


@query("idt_apply_spans", f"{L} select video_id, frame, cast(case when frame % 40 < 6 then 1 - instance else instance end as integer) instance, keypoint, x, y from pose_long")
def apply_spans(spark, d):
    p = X.pose_long(spark, d)
    starts = p.where("frame % 40 < 6").select("video_id", F.expr("(frame div 40) * 40").alias("start")).distinct()
    long = starts.select("video_id", "start", (F.col("start") + 5).alias("end"))
    short = starts.select("video_id", (F.col("start") + 20).alias("start"), (F.col("start") + 22).alias("end"))
    return O.apply_spans(p, long.union(short)).select(*KEYS, "keypoint", "x", "y")


@query("idt_apply_locked", f"{L} select video_id, frame, cast(case when frame % 40 between 2 and 5 or (frame % 40 = 22 and (frame // 40) % 2 = 0) then 1 - instance else instance end as integer) instance, keypoint, x, y from pose_long")
def apply_locked(spark, d):
    """Under the id lock: long spans with an ambiguous third frame, and short ones of which every second is ambiguous on its last frame."""
    p = X.pose_long(spark, d)
    starts = p.select("video_id", F.expr("(frame div 40) * 40").alias("start")).distinct()
    long = starts.select("video_id", "start", (F.col("start") + 5).alias("end"))
    short = starts.select("video_id", (F.col("start") + 20).alias("start"), (F.col("start") + 22).alias("end"))
    doubt = starts.select("video_id", (F.col("start") + 2).alias("frame")).union(starts.where("start div 40 % 2 = 0").select("video_id", F.col("start") + 22))
    return O.apply_spans(p, long.union(short), ambiguous=doubt).select(*KEYS, "keypoint", "x", "y")


@query("tri_cam_angles", f"{L} select video_id, frame, instance, keypoint, round(degrees(atan2({Z}, sqrt(x * x + y * y))), 6) elevation, round(degrees(atan2(y, x)), 6) azimuth from pose_long")
def cam_angles(spark, d):
    return O.bearings(X.pose_long(spark, d).withColumn("z", F.expr(Z))).select(*KEYS, "keypoint", R6("elevation"), R6("azimuth"))


_LINE = "round(case when {c} is not null then {c} else coalesce({c}0 + ({c}1 - {c}0) * (frame - f0) / (f1 - f0), {c}0, {c}1) end, 6) {c}"


@query("tri_com_export", f"""{L}, t as (select video_id, instance, frame, x, y, {Z} z from pose_long where keypoint = 1), g as (select video_id, frame, instance from (select distinct video_id, frame from pose_long), (values (0), (1)) i(instance)),
j as (select g.video_id, g.instance, g.frame, x, y, z, case when x is not null then g.frame end known from g left join t using (video_id, instance, frame)),
w as (select *, {", ".join(f"last_value({c} ignore nulls) over b {n}0, first_value({c} ignore nulls) over a {n}1" for c, n in (("x", "x"), ("y", "y"), ("z", "z"), ("known", "f")))} from j window b as (partition by video_id, instance order by frame rows between unbounded preceding and current row), a as (partition by video_id, instance order by frame rows between current row and unbounded following))
select video_id, instance, frame, {", ".join(_LINE.format(c=c) for c in "xyz")} from w""")
def com_export(spark, d):
    long = X.pose_long(spark, d).withColumn("z", F.expr(Z))
    grid = long.select("video_id", "frame").distinct().withColumn("instance", F.explode(F.array(F.lit(0), F.lit(1))))
    return O.centre_track(long, 1, grid).select("video_id", "instance", "frame", *map(R6, "xyz"))
