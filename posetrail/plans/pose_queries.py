"""Queries over poses: layouts, filters, geometry and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from posetrail.operators import pose as P
from posetrail.operators import runs as R
from posetrail.operators import tracks as T
from posetrail.plans import fixtures as X
from posetrail.plans.registry import query

L, LB = f"with {X.LONG_SQL}", f"with {X.LONG_SQL}, {X.BLOB_SQL}"
NAMES = ["nose", "center", "tailbase", "ear_l"]
R6 = lambda c, name=None: F.round(c, 6).alias(name or c)
KEYS = P.KEYS
# confidences are hundredths, so means tie with thresholds: they are summed in the order of the keypoints, as the operators do
MEAN_CONF = f"({' + '.join(f'coalesce(max(conf) filter (where keypoint = {k}), 0)' for k in range(X.K))}) / count(*)"
INST = f"inst as (select video_id, frame, instance, avg(x) cx, avg(y) cy, count(*) n, {MEAN_CONF} c from pose_long group by all)"
COUNTS = "counts as (select video_id, frame, cast(count(distinct instance) as bigint) n from pose_long group by all)"


def long6(pose):
    return P.to_long(pose).select(*KEYS, "keypoint", R6("x"), R6("y"), R6("conf"))


def simple(name, make, sql):
    query(name, f"{L} {sql}")(lambda spark, d: make(X.pose(spark, d)))


ROI = (150.0, 180.0, 900.0, 520.0)
OUT_ROI = "x >= 150 and x < 900 and y >= 180 and y < 520"


@query("flagship_count_spans", f"""{L}, kept as (select video_id, frame, instance from pose_long where {OUT_ROI} group by all having count(*) >= 4),
c as (select video_id, frame, count(*) n from kept group by all), ch as (select video_id, frame, lag(n) over (partition by video_id order by frame) b, n from c),
m as (select video_id, frame, frame - row_number() over (partition by video_id order by frame) g from ch where b <> n)
select video_id, min(frame) as "start", max(frame) as "end" from m group by video_id, g""")
def flagship(spark, d):
    pose = P.outside_roi(X.pose(spark, d), *ROI)
    pose = P.remove(pose, P.out_bodypart(4))
    counts = pose.where(P.visible() > 0).groupBy("video_id", "frame").agg(F.count(F.lit(1)).alias("n"))
    return R.spans(R.changes(counts, "n"))


simple("prj_mock_conf", lambda p: long6(P.mock_conf(p)), "select video_id, frame, instance, keypoint, round(x, 6) x, round(y, 6) y, 1.0::double conf from pose_long")
simple("prj_drop_conf", lambda p: P.drop_conf(p).select(*KEYS, F.posexplode("kps").alias("keypoint", "k")).select(*KEYS, "keypoint", "k.x", "k.y").where("x is not null"), "select video_id, frame, instance, keypoint, x, y from pose_long")
simple("prj_unflatten", lambda p: p.withColumn("flat", F.flatten(F.transform("kps", lambda k: F.array(k["x"], k["y"], k["conf"])))).select(*KEYS, F.explode(F.sequence(F.lit(0), F.lit(3))).alias("keypoint"), "flat").select(*KEYS, "keypoint", F.slice("flat", F.col("keypoint") * 3 + 1, 3).alias("v")).select(*KEYS, "keypoint", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"), F.col("v")[2].alias("conf")).where("x is not null"), "select video_id, frame, instance, keypoint, x, y, conf from pose_long")
simple("prj_neg_to_null", lambda p: P.to_long(P.neg_to_null(P.local(p))).select(*KEYS, "keypoint", R6("x"), R6("y")), "select video_id, frame, instance, keypoint, case when x - ax >= 0 then round(x - ax, 6) end x, case when y - ay >= 0 then round(y - ay, 6) end y from (select *, avg(x) over w ax, avg(y) over w ay from pose_long window w as (partition by video_id, frame, instance))")
simple("prj_kp_reorder", lambda p: long6(P.kp_reorder(p, [2, 1, 0, 3])), "select video_id, frame, instance, cast(case keypoint when 0 then 2 when 2 then 0 else keypoint end as integer) keypoint, round(x, 6) x, round(y, 6) y, round(conf, 6) conf from pose_long")


@query("prj_crop_shift", f"{L} select video_id, frame, instance, keypoint, x + 10 + video_id as x, y + 20 as y, conf from pose_long")
def crop_shift(spark, d):
    p = X.pose(spark, d)
    roi = p.select("video_id").distinct().select("video_id", (F.col("video_id") + 10).cast("double").alias("x1"), F.lit(20.0).alias("y1"))
    return P.to_long(P.crop_shift(p, roi))


simple("flt_inconsistent", lambda p: long6(P.clean_inconsistent(p.withColumn("kps", F.transform("kps", lambda k: F.struct(F.when(k["x"] % 5 != 0, k["x"]).alias("x"), k["y"].alias("y"), k["conf"].alias("conf")))))), "select video_id, frame, instance, keypoint, round(x, 6) x, round(y, 6) y, round(conf, 6) conf from pose_long where x % 5 <> 0")
simple("flt_roi", lambda p: long6(P.outside_roi(p, *ROI)), f"select video_id, frame, instance, keypoint, round(x, 6) x, round(y, 6) y, round(conf, 6) conf from pose_long where {OUT_ROI}")
simple("flt_zone", lambda p: long6(P.inside_zone(p, 300, 200, 600, 400)), "select video_id, frame, instance, keypoint, round(x, 6) x, round(y, 6) y, round(conf, 6) conf from pose_long where not (x between 300 and 600 and y between 200 and 400)")


@query("flt_mask", f"{L} select video_id, frame, instance, keypoint, x, y, conf from pose_long where not (x >= 400 and x < 440 and y >= 300 and y < 340)")
def flt_mask(spark, d):
    long = X.pose_long(spark, d)
    side = F.sequence(F.lit(0), F.lit(39))
    mask = long.select("video_id").distinct().select("video_id", F.explode(side).alias("i")).select("video_id", (F.col("i") + 400).alias("x"), F.explode(side).alias("j")).select("video_id", "x", (F.col("j") + 300).alias("y"))
    return P.masked(long, mask, 2000, 2000).select(*KEYS, "keypoint", "x", "y", "conf")


simple("flt_conf_cut", lambda p: P.conf_cut(p, 0.5).select(*KEYS, F.size("kps").cast("bigint").alias("n")), "select video_id, frame, instance, count(*) filter (where conf > 0.5) n from pose_long group by all")
simple("flt_frame_count", lambda p: P.frame_count(p, 2, 50), f", {COUNTS} select video_id, frame from (select *, row_number() over (partition by video_id order by frame) r from counts where n >= 2) where r <= 50".lstrip())
simple("out_remove", lambda p: long6(P.remove(p, P.out_bodypart(4))), "select video_id, frame, instance, keypoint, round(x, 6) x, round(y, 6) y, round(conf, 6) conf from (select *, count(*) over (partition by video_id, frame, instance) n from pose_long) where n >= 4")
simple("out_confidence", lambda p: p.where(P.out_confidence(0.4)).select(*KEYS), f", {INST} select video_id, frame, instance from inst where c < 0.4")
simple("out_bodypart", lambda p: p.where(P.out_bodypart(4)).select(*KEYS), f", {INST} select video_id, frame, instance from inst where n < 4")
simple("out_size", lambda p: P.out_size(p, 0.5, 2.0).where("out").select(*KEYS), f", {INST}, r as (select p.video_id, p.frame, p.instance, avg(sqrt((x - cx) ** 2 + (y - cy) ** 2)) r from pose_long p join inst i using (video_id, frame, instance) group by all), m as (select video_id, avg(r) m from r group by all) select video_id, frame, instance from r join m using (video_id) where r < 0.5 * m or r >= 2.0 * m")
BONE = """, b as (select a.video_id, a.frame, a.instance, t.bone, t.a ka, t.b kb, sqrt((a.x - c.x) ** 2 + (a.y - c.y) ** 2) len from pose_long a join (values (0, 0, 1), (1, 1, 2), (2, 1, 3)) t(bone, a, b) on a.keypoint = t.a
join pose_long c on c.video_id = a.video_id and c.frame = a.frame and c.instance = a.instance and c.keypoint = t.b), ref as (select video_id, bone, quantile_cont(len, 0.75) ref from b group by all), bad as (select * from b join ref using (video_id, bone) where len / ref > 2.0)"""
simple("out_bone", lambda p: P.out_bone(p, X.BONES, 2.0).where("out").select(*KEYS), f"{BONE} select distinct video_id, frame, instance from bad")
simple("out_bone_kp", lambda p: P.out_bone_kp(p, X.BONES, 2.0), f"{BONE}, e as (select video_id, frame, instance, ka k from bad union all select video_id, frame, instance, kb from bad) select video_id, frame, instance, cast(k as integer) keypoint from e group by video_id, frame, instance, k having count(*) >= case when k = 1 then 2 else 1 end")
simple("out_rotation", lambda p: p.where(P.out_rotation(0, 1, 2, 172.0)).select(*KEYS), "select h.video_id, h.frame, h.instance from pose_long h join pose_long c using (video_id, frame, instance) join pose_long t using (video_id, frame, instance) where h.keypoint = 0 and c.keypoint = 1 and t.keypoint = 2 and degrees(atan2(abs((h.x - c.x) * (t.y - c.y) - (h.y - c.y) * (t.x - c.x)), (h.x - c.x) * (t.x - c.x) + (h.y - c.y) * (t.y - c.y))) < 172")
PAIR = f""", {INST}, near as (select a.video_id, a.frame, count(*) filter (where sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 5) close from pose_long a join pose_long b using (video_id, frame, keypoint) where a.instance = 0 and b.instance = 1 group by all),
pr as (select n.*, i.n n_i, j.n n_j, i.c c_i, j.c c_j from near n join inst i on i.video_id = n.video_id and i.frame = n.frame and i.instance = 0 join inst j on j.video_id = n.video_id and j.frame = n.frame and j.instance = 1)"""
simple("out_duplicate", lambda p: P.out_duplicate(p, 0.5, 5.0), f"{PAIR} select video_id, frame, cast(case when close > greatest(n_i, n_j) * 0.5 then case when c_i >= c_j then 1 else 0 end else case when n_i > n_j then 1 else 0 end end as integer) instance from pr where close > 0 and close >= least(n_i, n_j) * 0.5")
simple("out_envelop", lambda p: P.out_envelop(p, 20.0), f""", {INST}, s as (select p.video_id, p.frame, p.instance, max((x - cx) ** 2 + (y - cy) ** 2) r, min(x) x1, max(x) x2, min(y) y1, max(y) y2 from pose_long p join inst using (video_id, frame, instance) group by all),
q as (select a.video_id, a.frame, case when a.r >= b.r then a else b end l, case when a.r >= b.r then b else a end sm from s a join s b on a.video_id = b.video_id and a.frame = b.frame and a.instance = 0 and b.instance = 1)
select video_id, frame, sm.instance as instance from q where sm.x1 > l.x1 - (l.x2 - l.x1) * 0.2 and sm.x2 < l.x2 + (l.x2 - l.x1) * 0.2 and sm.y1 > l.y1 - (l.y2 - l.y1) * 0.2 and sm.y2 < l.y2 + (l.y2 - l.y1) * 0.2""")
W = "window w as (partition by video_id, instance order by frame)"
simple("out_speed", lambda p: P.out_speed(p, 50.0).where("out").select(*KEYS), f", {INST}, l as (select *, lag(cx) over w px, lag(cy) over w py, lag(frame) over w pf from inst {W}) select video_id, frame, instance from l where pf = frame - 1 and sqrt((cx - px) ** 2 + (cy - py) ** 2) > 50")
simple("out_jump_kp", lambda p: P.out_jump_kp(p, 50.0), "select a.video_id, a.frame, a.instance, a.keypoint from pose_long a join pose_long b on a.video_id = b.video_id and a.instance = b.instance and a.keypoint = b.keypoint and b.frame = a.frame - 1 where sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) > 50")
simple("out_flicker", lambda p: P.out_flicker(p), f", {INST}, l as (select *, lag(frame) over w a, lead(frame) over w b from inst {W}) select video_id, frame, instance from l where (a is null or a <> frame - 1) and (b is null or b <> frame + 1)")
simple("geo_centroid", lambda p: P.with_centroid(p).select(*KEYS, R6("cx"), R6("cy")), f", {INST} select video_id, frame, instance, round(cx, 6) cx, round(cy, 6) cy from inst")
simple("geo_bbox", lambda p: P.bbox(p, 10.0).select(*KEYS, *(R6(c) for c in ("x1", "y1", "x2", "y2"))), "select video_id, frame, instance, round(min(x) - (max(x) - min(x)) * 0.1, 6) x1, round(min(y) - (max(y) - min(y)) * 0.1, 6) y1, round(max(x) + (max(x) - min(x)) * 0.1, 6) x2, round(max(y) + (max(y) - min(y)) * 0.1, 6) y2 from pose_long group by all")
VEC = """, pt as (select video_id, frame, instance, max(x) filter (where keypoint = 0) hx, max(y) filter (where keypoint = 0) hy, max(x) filter (where keypoint = 1) mx, max(y) filter (where keypoint = 1) my, max(x) filter (where keypoint = 2) tx, max(y) filter (where keypoint = 2) ty from pose_long group by all),
v as (select video_id, frame, instance, atan2(hy - my, hx - mx) a from pt union all select video_id, frame, instance, atan2(hy - ty, hx - tx) from pt union all select video_id, frame, instance, atan2(my - ty, mx - tx) from pt),
rot as (select video_id, frame, instance, atan2(sum(sin(a)), sum(cos(a))) angle from v where a is not null group by all)"""
simple("geo_rotation", lambda p: P.rotation(p, 0, 1, 2).select(*KEYS, R6("angle")), f"{VEC} select video_id, frame, instance, round(angle, 6) angle from rot")
ALIGN = f"{VEC}, {INST}, al as (select p.video_id, p.frame, p.instance, p.keypoint, (x - cx) * cos(-angle) - (y - cy) * sin(-angle) ax, (x - cx) * sin(-angle) + (y - cy) * cos(-angle) ay from pose_long p join rot using (video_id, frame, instance) join inst using (video_id, frame, instance))"
simple("geo_align", lambda p: P.to_long(P.aligned(p, 0, 1, 2)).select(*KEYS, "keypoint", R6("x"), R6("y")), f"{ALIGN} select video_id, frame, instance, keypoint, round(ax, 6) x, round(ay, 6) y from al")
simple("geo_pose_dim", lambda p: P.bbox(P.aligned(p, 0, 1, 2).select(*KEYS, "kps"), 0.0).select(*KEYS, R6(F.col("x2") - F.col("x1"), "width"), R6(F.col("y2") - F.col("y1"), "height")), f"{ALIGN} select video_id, frame, instance, round(max(ax) - min(ax), 6) width, round(max(ay) - min(ay), 6) height from al group by all")
CANON = f"{VEC}, {INST}, ca as (select p.video_id, p.keypoint, (x - cx) * cos(-atan2(hy - ty, hx - tx)) - (y - cy) * sin(-atan2(hy - ty, hx - tx)) ax, (x - cx) * sin(-atan2(hy - ty, hx - tx)) + (y - cy) * cos(-atan2(hy - ty, hx - tx)) ay from pose_long p join pt using (video_id, frame, instance) join inst using (video_id, frame, instance) where hx is not null and tx is not null), canon as (select video_id, keypoint, avg(ax) cx, avg(ay) cy from ca group by all)"
simple("geo_canonical", lambda p: P.canonical(p, 0, 2).select("video_id", "keypoint", R6("cx"), R6("cy")), f"{CANON} select video_id, keypoint, round(cx, 6) cx, round(cy, 6) cy from canon")
simple("geo_angle_map", lambda p: P.angle_map(P.canonical(p, 0, 2)), f"{CANON} select video_id, arg_min(keypoint, cx * cx + cy * cy) center_idx from canon group by all")
simple("geo_zoom_box", lambda p: P.zoom_box(p).select("video_id", "frame", R6("mx"), R6("my"), R6("zoom")), "select video_id, frame, round((min(x) + max(x)) / 2, 6) mx, round((min(y) + max(y)) / 2, 6) my, round(least(greatest(1000 / (greatest(max(x) - min(x), max(y) - min(y)) + 100), 0.1), 3.0), 6) zoom from pose_long group by all")
simple("geo_body_length", lambda p: P.body_length(p, 0, 2).select("video_id", R6("body_length")), f"{VEC} select video_id, round(quantile_cont(sqrt((hx - tx) ** 2 + (hy - ty) ** 2), 0.5), 6) body_length from pt where hx is not null and tx is not null group by all")
simple("agg_inst_count", lambda p: p.where(P.visible() > 0).groupBy("video_id", "frame").agg(F.count(F.lit(1)).alias("n")), f", {COUNTS} select * from counts")
simple("agg_inst_list", lambda p: p.where(P.visible() > 0).groupBy("video_id", "frame").agg(F.array_join(F.sort_array(F.collect_list("instance")), ",").alias("instances")), "select video_id, frame, string_agg(cast(instance as varchar), ',' order by instance) instances from (select distinct video_id, frame, instance from pose_long) group by all")
simple("agg_circular_mean", lambda p: P.rotation(p, 0, 1, 2).groupBy("video_id").agg(R6(F.atan2(F.avg(F.sin("angle")), F.avg(F.cos("angle"))), "angle")), f"{VEC} select video_id, round(atan2(avg(sin(angle)), avg(cos(angle))), 6) angle from rot group by all")
simple("win_count_change", lambda p: R.changes(p.where(P.visible() > 0).groupBy("video_id", "frame").agg(F.count(F.lit(1)).alias("n")), "n"), f", {COUNTS} select video_id, frame from (select *, lag(n) over (partition by video_id order by frame) b from counts) where b <> n")
simple("win_spans", lambda p: R.spans(p.where(P.visible() >= 4)), 'select video_id, min(frame) "start", max(frame) "end" from (select *, frame - row_number() over (partition by video_id order by frame) g from (select distinct video_id, frame from (select video_id, frame, instance from pose_long group by all having count(*) >= 4))) group by video_id, g')


@query("join_count_discrepancy", f"{LB}, {COUNTS} select video_id, frame, n, animal_count from counts join blobs using (video_id, frame) where n <> animal_count and animal_count <> 0")
def discrepancy(spark, d):
    n = X.pose(spark, d).where(P.visible() > 0).groupBy("video_id", "frame").agg(F.count(F.lit(1)).alias("n"))
    return n.join(X.blobs(spark, d), ["video_id", "frame"]).where("n <> animal_count and animal_count <> 0").select("video_id", "frame", "n", "animal_count")


@query("mrk_infer_nmi", f"""{LB}, {COUNTS}, ch as (select video_id, frame from (select *, lag(animal_count) over (partition by video_id order by frame) b from blobs) where b <> animal_count),
g as (select b.video_id, b.frame, animal_count, coalesce(n, 0) n from blobs b left join counts using (video_id, frame)) select video_id, frame from g where (animal_count >= 2 and n <= 1) or (n = 0 and exists (select 1 from ch where ch.video_id = g.video_id and ch.frame between g.frame - 10 and g.frame + 10))""")
def infer_nmi(spark, d):
    b = X.blobs(spark, d)
    n = X.pose(spark, d).where(P.visible() > 0).groupBy("video_id", "frame").agg(F.count(F.lit(1)).alias("n"))
    near = R.buffered(R.changes(b, "animal_count"), 10, b.groupBy("video_id").agg(F.max("frame").alias("last"))).withColumn("near", F.lit(True))
    g = b.join(n, ["video_id", "frame"], "left").join(near, ["video_id", "frame"], "left")
    return g.where("(animal_count >= 2 and coalesce(n, 0) <= 1) or (coalesce(near, false) and coalesce(n, 0) = 0)").select("video_id", "frame")


def _filled(c: str) -> str:
    return f"case when {c} is not null then {c} else coalesce({c}0 + ({c}1 - {c}0) * (frame - {c}f0) / ({c}f1 - {c}f0), {c}0, {c}1) end"


_ENDS = ", ".join(f"last_value({c} ignore nulls) over b {c}0, first_value({c} ignore nulls) over a {c}1, last_value(case when {c} is not null then frame end ignore nulls) over b {c}f0, first_value(case when {c} is not null then frame end ignore nulls) over a {c}f1" for c in ("x", "y", "conf"))
INTERP = f"""lim as (select video_id, max(frame) last from pose_long group by all), tr as (select distinct video_id, instance, keypoint from pose_long),
grid as (select video_id, instance, keypoint, unnest(generate_series(0::bigint, last)) as frame from tr join lim using (video_id)), ij as (select g.*, x, y, conf from grid g left join pose_long using (video_id, instance, keypoint, frame)),
ik as (select *, {_ENDS} from ij window b as (partition by video_id, instance, keypoint order by frame rows between unbounded preceding and current row), a as (partition by video_id, instance, keypoint order by frame rows between current row and unbounded following)),
ab as (select video_id, instance, frame from ij group by all having bool_and(x is null)), ag as (select *, frame - row_number() over (partition by video_id, instance order by frame) g from ab),
lost as (select video_id, instance, min(frame) s, max(frame) e from ag group by video_id, instance, g having count(*) > {{gap}}),
filled as (select video_id, instance, keypoint, frame, {", ".join(f"{_filled(c)} as {c}" for c in ("x", "y", "conf"))} from ik)"""
MAX_GAP = 3


def blocks(spark, d):
    """Long rows by video and block of frames, as the grid of tracks needs them."""
    return X.pose_long(spark, d, (T.tasks(spark), "video_id", T.block(F.col("frame"))))


def interpolated(spark, d, max_gap):
    """All keypoints and coordinates on the dense grid of each video; whole-instance gaps over max_gap are null again."""
    return P.interpolated(blocks(spark, d), max_gap)


@query("trk_interp_all", f"""{L}, {INTERP.format(gap=MAX_GAP)}, far as (select video_id, instance, unnest(generate_series(s, e)) frame, true as off from lost)
select video_id, instance, keypoint, frame, case when off is null then round(x, 6) end x, case when off is null then round(y, 6) end y, case when off is null then round(conf, 6) end conf from filled left join far using (video_id, instance, frame)""")
def interp_all(spark, d):
    return interpolated(spark, d, MAX_GAP).select("video_id", "instance", "keypoint", "frame", R6("x"), R6("y"), R6("conf"))


# the covariance by step, then the state of every track by step
@query("trk_kalman", f"""{L.replace('with ', 'with recursive ', 1)}, z as materialized (select video_id, instance, keypoint, frame, x, y, row_number() over (partition by video_id, instance, keypoint order by frame) k from pose_long), most as materialized (select max(k) m from z),
c0 as (select 1 as k, 50.0::double a, 0.0::double b, 50.0::double d), gain as materialized (select k, a + 2 * b + d + 0.2 as a, b + d + 0.4 as b, d + 0.8 as d from c0
    union all select k + 1, (1 - a / (a + 0.7)) * a + 2 * (1 - a / (a + 0.7)) * b + (d - b / (a + 0.7) * b) + 0.2, (1 - a / (a + 0.7)) * b + (d - b / (a + 0.7) * b) + 0.4, d - b / (a + 0.7) * b + 0.8 from gain, most where k < m),
s as (select video_id, instance, keypoint, frame, k, x, y, 0.0::double vx, 0.0::double vy from z where k = 1
    union all select z.video_id, z.instance, z.keypoint, z.frame, z.k, s.x + s.vx + g.a / (g.a + 0.7) * (z.x - s.x - s.vx), s.y + s.vy + g.a / (g.a + 0.7) * (z.y - s.y - s.vy), s.vx + g.b / (g.a + 0.7) * (z.x - s.x - s.vx), s.vy + g.b / (g.a + 0.7) * (z.y - s.y - s.vy)
    from s join z on z.video_id = s.video_id and z.instance = s.instance and z.keypoint = s.keypoint and z.k = s.k + 1 join gain g on g.k = z.k)
select video_id, instance, keypoint, frame, round(x, 6) x, round(y, 6) y from s""")
def kalman(spark, d):
    tracks = R.kalman(X.pose_long(spark, d), ("video_id", "instance", "keypoint"))
    return tracks.select("video_id", "instance", "keypoint", "frame", R6("x"), R6("y"))
