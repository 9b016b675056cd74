"""Queries over repairs, identities, exports and cameras."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from posetrail.operators import identity as I
from posetrail.operators import pose as P
from posetrail.operators import runs as R
from posetrail.plans import fixtures as X
from posetrail.plans.pose_queries import CANON, COUNTS, INST, KEYS, PAIR, R6, L, simple
from posetrail.plans.registry import oracle_sql, query

CENTRES = f"{L}, {INST}"


def centres(spark, d):
    return P.with_centroid(X.pose(spark, d).where(P.visible() > 0)).select(*KEYS, "cx", "cy")


simple("fix_missing_kp", lambda p: P.to_long(I.fill_missing(p, P.canonical(p, 0, 2), 3)).select(*KEYS, "keypoint", R6("x"), R6("y")), f"""{CANON}, m as (select p.video_id, p.frame, p.instance, avg(x) ox, avg(y) oy, avg(c.cx) mx, avg(c.cy) my from pose_long p join canon c using (video_id, keypoint) group by all having count(*) >= 3),
th as (select p.video_id, p.frame, p.instance, ox, oy, mx, my, atan2(sum((c.cx - mx) * (y - oy) - (c.cy - my) * (x - ox)), sum((c.cx - mx) * (x - ox) + (c.cy - my) * (y - oy))) b from pose_long p join canon c using (video_id, keypoint) join m using (video_id, frame, instance) group by all),
f as (select t.video_id, t.frame, t.instance, c.keypoint, ox + (c.cx - mx) * cos(b) - (c.cy - my) * sin(b) fx, oy + (c.cx - mx) * sin(b) + (c.cy - my) * cos(b) fy from th t join canon c using (video_id))
select f.video_id, f.frame, f.instance, f.keypoint, round(coalesce(p.x, fx), 6) x, round(coalesce(p.y, fy), 6) y from f left join pose_long p using (video_id, frame, instance, keypoint)""")


@query("trk_swap_orders", f"{L} select video_id, frame, cast(case when ((case when frame >= 100 then 1 else 0 end) + (case when frame >= 300 then 1 else 0 end) + (case when frame % 50 = 0 then 1 else 0 end)) % 2 = 1 then 1 - instance else instance end as integer) instance, count(*) n from pose_long group by all")
def swap_orders(spark, d):
    p = X.pose(spark, d)
    f = p.select("video_id", "frame").distinct()
    orders = f.select("video_id").distinct().select("video_id", F.explode(F.array(F.lit(100), F.lit(300)).cast("array<bigint>")).alias("frame"), F.lit("t").alias("kind")).union(f.where("frame % 50 = 0").withColumn("kind", F.lit("i")))
    return I.swap_orders(p, orders).select(*KEYS, P.visible().cast("bigint").alias("n"))




@query("fix_rotate_inst", f"{CENTRES} select video_id, frame, instance, keypoint, round(cx + (x - cx) * cos(0.5) - (y - cy) * sin(0.5), 6) x, round(cy + (x - cx) * sin(0.5) + (y - cy) * cos(0.5), 6) y from pose_long join inst using (video_id, frame, instance)")
def rotate(spark, d):
    p = P.with_centroid(X.pose(spark, d))
    turn = lambda k: P.turned(F.struct((k["x"] - F.col("cx")).alias("x"), (k["y"] - F.col("cy")).alias("y"), k["conf"].alias("conf")), F.lit(0.5))
    p = p.withColumn("kps", F.transform("kps", lambda k: F.struct((turn(k)["x"] + F.col("cx")).alias("x"), (turn(k)["y"] + F.col("cy")).alias("y"), k["conf"].alias("conf"))))
    return P.to_long(p).select(*KEYS, "keypoint", R6("x"), R6("y"))


@query("join_greedy_match", f"""{CENTRES}, o as (select video_id, frame, max(cx) filter (where instance = 0) x0, max(cy) filter (where instance = 0) y0, max(cx) filter (where instance = 1) x1, max(cy) filter (where instance = 1) y1 from inst group by all),
dd as (select a.video_id, b.frame, coalesce(sqrt((a.x0 - b.x0) ** 2 + (a.y0 - b.y0) ** 2), 1e6) + coalesce(sqrt((a.x1 - b.x1) ** 2 + (a.y1 - b.y1) ** 2), 1e6) k, coalesce(sqrt((a.x0 - b.x1) ** 2 + (a.y0 - b.y1) ** 2), 1e6) + coalesce(sqrt((a.x1 - b.x0) ** 2 + (a.y1 - b.y0) ** 2), 1e6) s from o a join o b on a.video_id = b.video_id and b.frame = a.frame + 1)
select video_id, frame, s < k as "swap" from dd""")
def greedy(spark, d):
    c = centres(spark, d)
    return I.greedy_match(c.withColumn("frame", F.col("frame") + 1), c)


@query("join_merge_pred", f"{L} select video_id, frame, instance, keypoint, case when frame % 10 = 0 then x + 1 else x end x, y, conf from pose_long")
def merge(spark, d):
    long = X.pose_long(spark, d)
    return I.merge_predictions(long, long.withColumn("x", F.col("x") + 1), long.where("frame % 10 = 0").select("video_id", "frame").distinct())


simple("join_inst_pairs", lambda p: P.pairs(p).select("video_id", "frame", "i", "j"), "select video_id, frame, 0 as i, 1 as j from pose_long group by video_id, frame having count(distinct instance) = 2")


@query("exp_refine", f"""{L}, {COUNTS}, m as (select video_id, frame, frame - row_number() over (partition by video_id order by frame) g from counts where n = 2), r as (select video_id, min(frame) s, max(frame) e, count(*) len from m group by video_id, g)
select video_id, s as "start", e as "end" from (select *, row_number() over (partition by video_id order by s) q from r where len >= 5 and s >= 100 and e < 1900) where q <= 10""")
def refine(spark, d):
    """First ten runs of each video with all animals, of five frames at least, inside the segment."""
    full = X.pose(spark, d).where(P.visible() > 0).groupBy("video_id", "frame").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    r = R.spans(full).where('`end` - `start` >= 4 and `start` >= 100 and `end` < 1900')
    return r.withColumn("q", F.row_number().over(Window.partitionBy("video_id").orderBy("start"))).where("q <= 10").drop("q")


simple("idt_prepare", lambda p: I.prepared(p, 0, 1, 2)[1].groupBy("video_id", "frame").agg(F.count("cx").alias("n")), f"{PAIR}, dup as (select video_id, frame, cast(case when close > greatest(n_i, n_j) * 0.5 then case when c_i >= c_j then 1 else 0 end else case when n_i > n_j then 1 else 0 end end as integer) instance from pr where close > 0 and close >= least(n_i, n_j) * 0.5) select video_id, frame, count(*) n from inst anti join dup using (video_id, frame, instance) where n > 1 group by all")


CENTRES_SQL = f"{L}, {INST} select video_id, frame, instance, cx, cy from inst"
_D = "sqrt((q{k}x - x{a}) ** 2 + (q{k}y - y{a}) ** 2)"
_PLACE = ", ".join(f"case when off or not heir{k} then q{k}{c} else case when swap then {c}{1 - k} else {c}{k} end end p{k}{c}" for k in (0, 1) for c in "xy")
# a state for each video, frame by frame: the last places and when they were seen; a frame with a place missing gives nulls, which cost nothing
SWEEP = f"""with recursive cen as (select * from ({{centres}})), len as (select video_id, body_length from ({{lengths}})),
fr as materialized (select video_id, frame, max(cx) filter (where instance = 0) x0, max(cy) filter (where instance = 0) y0, max(cx) filter (where instance = 1) x1, max(cy) filter (where instance = 1) y1, max(body_length) len, row_number() over (partition by video_id order by frame) i from cen join len using (video_id) group by video_id, frame),
st as (select video_id, frame, i, x0 p0x, y0 p0y, x1 p1x, y1 p1y, case when x0 is not null then frame end t0, case when x1 is not null then frame end t1, false as swap, false as doubt from fr where i = 1
union all select video_id, frame, i, {_PLACE}, case when off or not heir0 then t0 else frame end, case when off or not heir1 then t1 else frame end, swap and not off, off or doubt from (
select *, case when swap then x1 else x0 end is not null heir0, case when swap then x0 else x1 end is not null heir1 from (
select *, nk + nc > 0 and coalesce(case when swap then crossed else keep end > 1.2 * len * case when nk = 2 and nc = 2 then 1.5 else 1 end, false) off, nk > 0 and nc > 0 and abs(keep - crossed) < 0.15 * (keep + crossed) doubt from (
select *, nc > 0 and (nk = 0 or crossed < keep) swap from (
select *, coalesce(g00, 0) + coalesce(g11, 0) keep, coalesce(g01, 0) + coalesce(g10, 0) crossed, (g00 is not null)::int + (g11 is not null)::int nk, (g01 is not null)::int + (g10 is not null)::int nc from (
select *, {", ".join(f"{_D.format(k=k, a=a)} g{k}{a}" for k in (0, 1) for a in (0, 1))} from (
select f.*, t0, t1, {", ".join(f"case when f.frame - t{k} <= 10 then p{k}{c} end q{k}{c}" for k in (0, 1) for c in "xy")} from st join fr f on f.video_id = st.video_id and f.i = st.i + 1)))))))
select video_id, frame, swap, doubt as ambiguous from st"""


@query("idt_motion_sweep", SWEEP.format(centres=CENTRES_SQL, lengths=oracle_sql()["geo_body_length"]))
def sweep(spark, d):
    return I.motion_sweep(centres(spark, d), P.body_length(X.pose(spark, d), 0, 2)).drop("locked_from")


@query("idt_id_lock")
def id_lock(spark, d):
    c = centres(spark, d)
    return I.motion_sweep(c, P.body_length(X.pose(spark, d), 0, 2), I.single_frames(X.blobs(spark, d), c))


@query("idt_swap_candidates", """with cl as (select cast(o_orderkey // 2000 as bigint) video_id, cast(o_orderkey % 2000 as bigint) frame, cast((o_custkey // 7) % 3 as integer) class from orders),
r0 as (select *, case when lag(class) over w is distinct from class then 1 else 0 end c from cl window w as (partition by video_id order by frame)), r1 as (select *, sum(c) over (partition by video_id order by frame) r from r0), r as (select video_id, r, class, min(frame) s, max(frame) e from r1 group by all),
f as (select *, lag(class) over w a, lead(class) over w b from r window w as (partition by video_id order by s)), g as (select video_id, s, e, case when class = 0 and a is not null and b is not null then case when a = b then a else 1 end else class end class from f),
h0 as (select *, case when lag(class) over w is distinct from class then 1 else 0 end c from g window w as (partition by video_id order by s)), h1 as (select *, sum(c) over (partition by video_id order by s) q from h0)
select video_id, min(s) as "start", max(e) as "end" from h1 where class = 1 group by video_id, q having sum(e - s + 1) >= 3""")
def candidates(spark, d):
    cl = X.read(spark, d, "orders").selectExpr("cast(o_orderkey div 2000 as bigint) video_id", "cast(o_orderkey % 2000 as bigint) frame", "cast((o_custkey div 7) % 3 as int) class")
    return I.swap_candidates(cl)


@query("idt_kmeans_conf")
def kmeans(spark, d):
    return I.two_clusters(X.embeddings(spark, d))


CAMS = [[800.0, 0.0, 320.0, 0.0, 0.0, 800.0, 240.0, 0.0, 0.0, 0.0, 1.0, 1000.0], [800.0, 0.0, 320.0, 80000.0, 0.0, 800.0, 240.0, 0.0, 0.0, 0.0, 1.0, 1000.0], [800.0, 0.0, 320.0, 0.0, 0.0, 800.0, 240.0, 80000.0, 0.0, 0.0, 1.0, 1100.0]]
Z = "cast((frame * 7 + keypoint * 13) % 50 as double)"
CAM_SQL = ", cams as (select * from (values " + ", ".join(f"({i}, {p}::double[])" for i, p in enumerate(CAMS)) + ") t(cam, p))"


def cameras(spark):
    return spark.createDataFrame(list(enumerate(CAMS)), "cam int, p array<double>")


def views(spark, d):
    pts = X.pose_long(spark, d).withColumn("z", F.expr(Z))
    return I.project(pts, cameras(spark))


def noisy(spark, d):
    """Views that are off by some pixels, so weights and errors matter."""
    off = lambda k: (F.col("frame") * k + F.col("keypoint") * 5 + F.col("cam") * 3) % 7 - 3
    return views(spark, d).where("conf > 0").withColumns({"u": F.col("u") + off(3) / 10.0, "v": F.col("v") + off(4) / 10.0}).drop("p")


@query("tri_project", f"{L}{CAM_SQL} select video_id, frame, instance, keypoint, cam, round((p[1] * x + p[2] * y + p[3] * {Z} + p[4]) / (p[9] * x + p[10] * y + p[11] * {Z} + p[12]), 6) u, round((p[5] * x + p[6] * y + p[7] * {Z} + p[8]) / (p[9] * x + p[10] * y + p[11] * {Z} + p[12]), 6) v from pose_long, cams")
def tri_project(spark, d):
    return views(spark, d).select(*KEYS, "keypoint", "cam", R6("u"), R6("v"))


@query("tri_point", f"{L} select video_id, frame, instance, keypoint, round(x, 4) x, round(y, 4) y, round({Z}, 4) z from pose_long where conf > 0")
def tri_point(spark, d):
    """Points projected into three cameras come back from their views."""
    t = I.triangulate(views(spark, d).where("conf > 0").drop("p"), cameras(spark), [*KEYS, "keypoint"])
    return t.select(*KEYS, "keypoint", *((F.round(c, 4) + F.lit(0.0)).alias(c) for c in "xyz"))


@query("tri_confidence")
def tri_confidence(spark, d):
    """Points from views with errors, and their confidence; tests hold it against a point-by-point calculation."""
    return I.triangulate(noisy(spark, d), cameras(spark), [*KEYS, "keypoint"])


@query("tri_valid_views", f"{L}{CAM_SQL}, s as (select video_id, frame, cam, count(distinct instance) n from pose_long, cams where (pose_long.instance + cam + frame) % 4 <> 0 group by all) select video_id, frame, count(*) n_views from s where n >= 2 group by all having count(*) >= 2")
def valid_views(spark, d):
    s = views(spark, d).where("(instance + cam + frame) % 4 <> 0").groupBy("video_id", "frame", "cam").agg(F.count_distinct("instance").alias("n"))
    return s.where("n >= 2").groupBy("video_id", "frame").agg(F.count(F.lit(1)).alias("n_views")).where("n_views >= 2")


@query("win_velocity3d", f"""{L}, t as (select *, {Z} z from pose_long), pl as (select distinct video_id, instance, frame from t), kp as (select distinct video_id, instance, keypoint from t),
j as (select pl.video_id, pl.instance, kp.keypoint, pl.frame, b.frame t, b.x, b.y, b.z, b.conf - min(b.conf) over (partition by pl.video_id, pl.instance, kp.keypoint, pl.frame) + 1e-8 w
from pl join kp using (video_id, instance) join t b on b.video_id = pl.video_id and b.instance = pl.instance and b.keypoint = kp.keypoint and b.frame between pl.frame - 5 and pl.frame),
m as (select video_id, instance, keypoint, frame, count(*) n, sum(w) s, sum(w * t) / sum(w) mt, sum(w * x) / sum(w) mx, sum(w * y) / sum(w) my, sum(w * z) / sum(w) mz from j group by all having count(*) >= 2),
sl as (select j.video_id, j.instance, j.keypoint, j.frame, sum(w * (t - mt) * (x - mx)) / sum(w * (t - mt) ** 2) sx, sum(w * (t - mt) * (y - my)) / sum(w * (t - mt) ** 2) sy, sum(w * (t - mt) * (z - mz)) / sum(w * (t - mt) ** 2) sz from j join m using (video_id, instance, keypoint, frame) group by all)
select video_id, instance, frame, round(avg(sqrt(sx * sx + sy * sy + sz * sz)), 2) speed from sl group by all""")
def velocity(spark, d):
    t = X.pose_long(spark, d).withColumn("z", F.expr(Z))
    return I.velocity3d(t, ["video_id", "instance"]).select("video_id", "instance", "frame", F.round("speed", 2).alias("speed"))
