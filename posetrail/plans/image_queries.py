"""Queries over pixel rows, cameras, centres and further joins and exports."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from posetrail.operators import files as O
from posetrail.operators import frames as G
from posetrail.operators import identity as I
from posetrail.operators import pose as P
from posetrail.plans import fixtures as X
from posetrail.plans.identity_queries import CAM_SQL, Z, cameras, views
from posetrail.plans.pose_queries import ALIGN, KEYS, R6, VEC, L, simple
from posetrail.plans.registry import oracle_sql, query
from posetrail.plans.series_queries import annot

QUANTILES = {"median": 0.5, "p5": 0.05, "p10": 0.1, "p25": 0.25, "p75": 0.75, "p90": 0.9, "p95": 0.95}
TONES = {"b": "(frame * 7 + x * 13 + y * 29 + o_custkey) % 256", "g": "(frame * 3 + x * 17 + o_custkey * 5) % 256", "r": "(frame * 11 + y * 31 + o_custkey * 3) % 256"}
PIXELS = f"with px0 as (select cast(o_orderkey // 2000 as bigint) video_id, cast(o_orderkey % 2000 as bigint) frame, o_custkey, cast(x as integer) x, cast(y as integer) y from orders, generate_series(0, 5) a(x), generate_series(0, 3) b(y)), px as (select video_id, frame, x, y, {', '.join(f'cast({v} as integer) {k}' for k, v in TONES.items())} from px0)"
GRAY = "cast((114 * b + 587 * g + 299 * r + 500) // 1000 as integer)"
NEAR = ", pf as (select distinct video_id, frame from px), pn as (select *, row_number() over (partition by video_id order by frame) - 1 i, count(*) over (partition by video_id) n from pf), near as (select px.* from px join pn using (video_id, frame) where n <= 100 or exists (select 1 from range(100) t(s) where floor(s * (n - 1) / 99.0::double) = i))"


def images(spark, d):
    """The pixels of SQL as binary frames of 6 x 4, an order each: its tones, pixel by pixel and row by row, as hexadecimal digits."""
    o = X.read(spark, d, "orders").selectExpr("cast(o_orderkey div 2000 as bigint) video_id", "cast(o_orderkey % 2000 as bigint) frame", "o_custkey")
    tone = lambda k, x, y: "(" + re.sub(r"\bx\b", str(x), re.sub(r"\by\b", str(y), TONES[k])) + ")"
    pixel = lambda x, y: F.expr(f"substr(hex(16777216 + {tone('b', x, y)} * 65536 + {tone('g', x, y)} * 256 + {tone('r', x, y)}), 2)")
    size = [F.lit(v).cast("int").alias(n) for n, v in (("h", 4), ("w", 6), ("c", 3))]
    return o.select("video_id", "frame", *size, F.unhex(F.concat(*(pixel(x, y) for y in range(4) for x in range(6)))).alias("data"))


def image(name, make, sql):
    query(name, f"{PIXELS}{sql}")(lambda spark, d: make(images(spark, d)))


def grounds(i):
    """Pixel rows of every statistic of the gray background."""
    rows = lambda a, *more: [G.pixel_rows(a, *(G.stacked(m, *a.shape[1:]) for m in more))]
    first, *others = G.STATISTICS
    return G.kernel(G.background(G.gray(i)), rows, f"x int, y int, {', '.join(f'{s} int' for s in G.STATISTICS)}", extra=tuple(others), data=first, keys=("video_id",))


def masked(i):
    """Places of the smart mask of light blobs, which is -255."""
    ground = G.background(i).select("video_id", "h", "w", "c", F.col("median").alias("data"))
    return G.unpacked(G.smart_mask(i, ground, dark=False), ("on",), keys=("video_id",)).where("on = 1").select("video_id", "x", "y", F.lit(-255).alias("mask"))


def diagonal(i):
    """White paint on the diagonal of each video's frames."""
    size = i.groupBy("video_id").agg(F.first("h").alias("h"), F.first("w").alias("w"))
    line = F.concat(F.repeat(F.lit("00"), F.col("w")), F.lit("02"))  # a line on, the mark stands one pixel further right
    return size.select("video_id", F.unhex(F.substr(F.concat(F.lit("02"), F.repeat(line, F.col("h"))), F.lit(1), 2 * F.col("h") * F.col("w"))).alias("data"))


_byte = lambda v: f"cast(floor(round({v}, 6)) as integer)"
image("img_gray", lambda i: G.unpacked(G.gray(i), ("gray",)), f" select video_id, frame, x, y, {GRAY} gray from px")
image("agg_background", grounds, f"{NEAR}, gr as (select *, {GRAY} v from near) select video_id, x, y, {_byte('avg(v)')} as mean, min(v) as least, max(v) as most, {', '.join(f'{_byte(f'quantile_cont(v, {q})')} as {k}' for k, q in QUANTILES.items())} from gr group by all")
image("agg_smart_mask", masked, f"{NEAR}, gd as (select video_id, x, y, {', '.join(f'{_byte(f'quantile_cont({c}, 0.5)')} {c}0' for c in 'bgr')} from near group by all), fr as (select video_id, (114 * b + 587 * g + 299 * r) / 1000.0::double tone from px join gd using (video_id, x, y) where greatest(abs(b - b0), abs(g - g0), abs(r - r0)) >= 25), tn as (select video_id, quantile_cont(tone, 0.8) tone from fr group by all having count(*) >= 100) select video_id, x, y, cast(-255 as integer) mask from gd join tn using (video_id) where round((114 * b0 + 587 * g0 + 299 * r0) / 1000.0::double, 6) >= round(tone * 0.7::double, 6)")
image("img_augment", lambda i: G.unpacked(G.augmented(i, diagonal(i), (1, 1, 5, 4)), ("gray",)), f" select video_id, frame, cast(x - 1 as integer) x, cast(y - 1 as integer) y, case when x = y then 255 else {GRAY} end gray from px where x >= 1 and x < 5 and y >= 1")
annot("img_blob_count", lambda a: G.blob_counts(a.withColumn("frame", F.expr("frame div 3")), 50.0), " select video_id, frame // 3 as frame, cast(sum(case when area >= 50 then 2 else 1 end) as bigint) animal_count, max(case when area >= 50 then 1 else 0 end)::integer merged from annot group by all")


# --- poses ---

CENTRE_SQL = f"select video_id, frame, instance, x as cx, y as cy from ({oracle_sql()['fix_missing_kp']}) where keypoint = 1"


@query("geo_anat_center", CENTRE_SQL)
def anat_center(spark, d):
    return I.anatomical_center(X.pose(spark, d), 0, 1, 2).select(*KEYS, R6("cx"), R6("cy"))


_FILLED = oracle_sql()["fix_missing_kp"].replace("round(coalesce(p.x, fx), 6)", "coalesce(p.x, fx)").replace("round(coalesce(p.y, fy), 6)", "coalesce(p.y, fy)")


@query("geo_aligned_local", f"{L}{VEC}, ce as (select video_id, frame, instance, x cx, y cy from ({_FILLED}) where keypoint = 1) select video_id, frame, instance, keypoint, round((x - cx) * cos(-angle) - (y - cy) * sin(-angle), 6) x, round((x - cx) * sin(-angle) + (y - cy) * cos(-angle), 6) y, conf from pose_long join rot using (video_id, frame, instance) join ce using (video_id, frame, instance)")
def aligned_local(spark, d):
    return P.to_long(I.aligned_local(X.pose(spark, d), 0, 1, 2)).select(*KEYS, "keypoint", R6("x"), R6("y"), "conf")


PAIRS = [(0, 1, 0.9), (1, 2, 0.5), (1, 3, 0.05), (0, 2, 0.25)]
_KP = ", ".join(f"max(x) filter (where keypoint = {k}) x{k}, max(y) filter (where keypoint = {k}) y{k}" for k in range(4))
simple("geo_weighted_vec", lambda p: P.weighted_vectors(p, PAIRS).select(*KEYS, F.posexplode("vectors").alias("pair", "v")).select(*KEYS, "pair", R6(F.col("v.dx"), "dx"), R6(F.col("v.dy"), "dy")), f", wp as (select video_id, frame, instance, {_KP} from pose_long group by all) " + " union all ".join(f"select video_id, frame, instance, {n}::integer pair, round({w} * (x{j} - x{i}), 6) dx, round({w} * (y{j} - y{i}), 6) dy from wp" for n, (i, j, w) in enumerate(t for t in PAIRS if t[2] >= 0.1)))


@query("geo_head_tail", "select cast(4 as bigint) n, s_suppkey, cast(case when s_suppkey % 3 = 0 then 2 else 0 end as integer) head, cast(case when s_suppkey % 3 = 0 then 3 else 1 end as integer) tail from supplier")
def head_tail(spark, d):
    """Keypoint lists of projects, one for each supplier."""
    names = F.when(F.col("s_suppkey") % 3 == 0, F.array(*map(F.lit, ("Ear_L", "Mid", "SNOUT", "Hip R")))).otherwise(F.array(*map(F.lit, ("nose", "Tail_Base", "ear", "back"))))
    s = X.read(spark, d, "supplier").select("s_suppkey", names.alias("names"))
    return s.select(F.size("names").cast("bigint").alias("n"), "s_suppkey", O.first_named("names", O.HEAD_NAMES).alias("head"), O.first_named("names", O.TAIL_NAMES).alias("tail"))


# --- joins, exports, cameras ---


@query("join_unlabeled", f"{L}, im as (select distinct video_id, frame from pose_long) select video_id, frame from im where frame % 4 <> 3")
def unlabeled(spark, d):
    im = X.pose_long(spark, d).select("video_id", "frame").distinct()
    return im.join(im.where("frame % 4 = 3"), ["video_id", "frame"], "left_anti")


@query("exp_label_crop", f"{L} select 'labeled-data/v' || video_id || '/img' || lpad(cast(frame as varchar), 8, '0') || '.png' as path, instance, keypoint, x - 10 - video_id as x, y - 20 as y from pose_long")
def label_crop(spark, d):
    p = X.pose(spark, d)
    roi = p.select("video_id").distinct().select("video_id", (F.col("video_id") + 10).cast("double").alias("x1"), F.lit(20.0).alias("y1"))
    rows = P.to_long(P.crop_shift(p, roi, -1))
    return rows.select(O.image_path(F.concat(F.lit("v"), F.col("video_id")), F.col("frame")).alias("path"), "instance", "keypoint", "x", "y")


simple("idt_cutout_spec", lambda p: P.cutout_size(P.aligned(p, 0, 1, 2).select(*KEYS, "kps")), f"{ALIGN}, dm as (select video_id, max(ax) - min(ax) w, max(ay) - min(ay) h from al group by video_id, frame, instance), sz as (select video_id, cast(floor(round(greatest(quantile_cont(w, 0.9), quantile_cont(h, 0.9)) * 1.15, 6)) as bigint) s from dm group by all) select video_id, s + s % 2 as size from sz")


@query("idt_agreement", "with s as (select cast(o_orderkey // 2000 as bigint) video_id, cast(o_orderkey % 2000 // 2 as bigint) frame, o_custkey % 2 as cluster, o_orderkey % 2 as motion_id, (o_custkey % 10) / 10.0::double confidence from orders), c as (select * from s where confidence >= 0.3), m as (select video_id, avg(case when cluster = motion_id then 1.0::double else 0 end) < 0.5 as flip from c group by all) select video_id, frame, sum(case when (cluster = motion_id) <> flip then 0.5::double else 0 end) agreement from c join m using (video_id) group by all")
def agreement(spark, d):
    s = X.read(spark, d, "orders").selectExpr("cast(o_orderkey div 2000 as bigint) video_id", "cast(o_orderkey % 2000 div 2 as bigint) frame", "o_custkey % 2 cluster", "o_orderkey % 2 motion_id", "cast(o_custkey % 10 as double) / 10 confidence")
    return I.agreement(s)


@query("src_multi_cam", f"{L}{CAM_SQL}, n as (select video_id, min(last) total from (select video_id, 1 as side, max(frame) - 1 as last from pose_long group by all union all select video_id, 0, max(frame) - 3 from pose_long group by all) group by all) select video_id, frame, cast(cam as integer) cam, count(*) n from pose_long join n using (video_id), cams where frame <= total and cam < 2 group by all")
def multi_cam(spark, d):
    long = X.pose_long(spark, d)
    last = long.groupBy("video_id").agg(F.max("frame").alias("last"))
    cut = lambda k: long.join(last, "video_id").where(F.col("frame") <= F.col("last") - k).drop("last")
    both = I.cameras_together({0: cut(3), 1: cut(1)})
    return both.groupBy("video_id", "frame", "cam").agg(F.count(F.lit(1)).alias("n"))


@query("join_multiview", f"{L}{CAM_SQL} select video_id, frame, instance, keypoint, count(*) n_views, string_agg(cast(cam as varchar), ',' order by cam) cams from pose_long, cams where (instance + cam + frame) % 4 <> 0 group by all")
def multiview(spark, d):
    g = views(spark, d).where("(instance + cam + frame) % 4 <> 0").groupBy(*KEYS, "keypoint").agg(F.sort_array(F.collect_list(F.struct("cam", "u", "v", "conf", "p"))).alias("o"))
    return g.select(*KEYS, "keypoint", F.size("o").cast("bigint").alias("n_views"), F.array_join(F.transform("o", lambda o: o["cam"].cast("string")), ",").alias("cams"))


@query("src_calibration", "with c as (select s_suppkey, radians(s_suppkey % 360) a, s_nationkey::double t0, (s_suppkey % 7)::double t1 from supplier) select s_suppkey, round(-(cos(a) * t0 + sin(a) * t1), 6) px, round(-(cos(a) * t1 - sin(a) * t0), 6) py, round(800 * cos(a), 6) p0, round(-800 * sin(a), 6) p1, round(800 * t0 + 320 * 5, 6) p3, 5.0::double p11 from c")
def calibration(spark, d):
    """Cameras turned about their axis, one for each supplier."""
    a = F.radians(F.col("s_suppkey") % 360)
    s = X.read(spark, d, "supplier").select(
        "s_suppkey", F.array(*map(F.lit, (800.0, 0.0, 320.0, 0.0, 800.0, 240.0, 0.0, 0.0, 1.0))).alias("k"),
        F.array(F.cos(a), -F.sin(a), F.lit(0.0), F.sin(a), F.cos(a), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("r"),
        F.array(F.col("s_nationkey").cast("double"), (F.col("s_suppkey") % 7).cast("double"), F.lit(5.0)).alias("t"),
    )
    at = lambda c, i, n: R6(F.col(c)[i] + F.lit(0.0), n)
    return I.calibrated(s).select("s_suppkey", at("position", 0, "px"), at("position", 1, "py"), at("p", 0, "p0"), at("p", 1, "p1"), at("p", 3, "p3"), at("p", 11, "p11"))


K1 = (0.05, 0.01, 0.001, -0.002)


def _undistorted_sql():
    steps, last = [], "u0"
    for i in range(1, 6):
        steps.append(f"u{i} as (select *, (x0 - (2 * {K1[2]} * ux * uy + {K1[3]} * (ux * ux + uy * uy + 2 * ux * ux))) / (1 + ({K1[0]} + {K1[1]} * (ux * ux + uy * uy)) * (ux * ux + uy * uy)) nx, (y0 - ({K1[2]} * (ux * ux + uy * uy + 2 * uy * uy) + 2 * {K1[3]} * ux * uy)) / (1 + ({K1[0]} + {K1[1]} * (ux * ux + uy * uy)) * (ux * ux + uy * uy)) ny from {last}), v{i} as (select * exclude (ux, uy, nx, ny), nx ux, ny uy from u{i})")
        last = f"v{i}"
    return f"{L}, u0 as (select *, (x - 320) / 800 x0, (y - 240) / 800 y0, (x - 320) / 800 ux, (y - 240) / 800 uy from pose_long), {', '.join(steps)} select video_id, frame, instance, keypoint, round(ux * 800 + 320, 6) x, round(uy * 800 + 240, 6) y, conf from {last}".replace("0.05", "0.05::double").replace("0.01 ", "0.01::double ")


@query("tri_undistort", _undistorted_sql())
def undistort(spark, d):
    p = I.undistorted(X.pose_long(spark, d), (800.0, 800.0, 320.0, 240.0), K1)
    return p.select(*KEYS, "keypoint", R6("x"), R6("y"), "conf")


SCORED = "select video_id, frame, animal_count * 20 + frame % 37 as score from blobs"


@query("tri_roi_frames", f"select video_id, frame from ({oracle_sql()['win_velocity3d']}) where instance = 1 and speed >= 20 union select video_id, frame from (with {X.BLOB_SQL} {SCORED}) where score >= 50")
def roi_frames(spark, d):
    """The swap score is an input; here it comes from the counts."""
    from posetrail.plans.identity_queries import velocity

    scores = X.blobs(spark, d).select("video_id", "frame", (F.col("animal_count") * 20 + F.col("frame") % 37).alias("score"))
    return I.roi_frames(velocity(spark, d), scores)


@query("tri_pose", f"{L} select video_id, frame, instance, k as keypoint, case when conf > 0 then round(x, 3) end x, case when conf > 0 then round(y, 3) end y, case when conf > 0 then round({Z.replace('keypoint', 'k')}, 3) end z from (select distinct video_id, frame, instance from pose_long where conf > 0) a cross join range(4) t(k) left join (select *, keypoint as k from pose_long) b using (video_id, frame, instance, k)")
def tri_pose(spark, d):
    """Whole poses, null keypoints included."""
    t = I.triangulated_poses(views(spark, d).drop("p"), cameras(spark), X.K)
    rows = t.select(*KEYS, F.posexplode("kps").alias("keypoint", "p"))
    return rows.select(*KEYS, F.col("keypoint").cast("bigint").alias("keypoint"), *((F.round(f"p.{c}", 3) + F.lit(0.0)).alias(c) for c in "xyz"))
