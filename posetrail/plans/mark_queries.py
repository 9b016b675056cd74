"""Queries over categories, reviews, overlays, combined masks and second modes of detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from posetrail.operators import frames as G
from posetrail.operators import marks as K
from posetrail.operators import pose as P
from posetrail.operators import runs as R
from posetrail.plans import fixtures as X
from posetrail.plans.image_queries import PIXELS, images
from posetrail.plans.pose_queries import ALIGN, BONE, INST, KEYS, R6, L, LB
from posetrail.plans.registry import query
from posetrail.plans.series_queries import NAMES, RUNS, A

CATS = "case label when 0 then 'labeled' when 1 then 'refined' when 2 then 'marked' when 3 then 'rejected' else 'approved' end"
MARKS = f"{A}, marks as (select video_id, frame, {CATS} category from annot)"


def marks(spark, d):
    names = F.array(*map(F.lit, ("labeled", "refined", "marked", "rejected", "approved")))
    return X.annot(spark, d).select("video_id", "frame", F.element_at(names, F.col("label") + 1).alias("category"))


@query("set_move", f"{MARKS} select distinct video_id, frame, case when category = 'marked' then 'refined' when category = 'approved' and frame % 3 = 0 then 'rejected' when category = 'labeled' then null else category end category from marks where category <> 'labeled'")
def set_move(spark, d):
    """A whole category moves, then listed frames of another, then one is cleared."""
    m = marks(spark, d)
    m = K.move(m, "refined", "marked")
    m = K.move(m, "rejected", "approved", m.where("frame % 3 = 0"))
    return K.clear(m, ["labeled"])


@query("set_status_flow", f"{MARKS} select video_id, frame, case category when 'labeled' then 'refined' when 'refined' then 'marked' end category from marks where frame % 2 = 0 and category in ('labeled', 'refined') union all select video_id, frame, case when category in ('rejected', 'approved') then 'marked' else category end from marks where frame % 2 = 1")
def status_flow(spark, d):
    """A step on every second frame, then the switch to labelling."""
    m = marks(spark, d)
    return K.switch_view(K.toggle(m, m.where("frame % 2 = 0")))


@query("win_bouts", f"""{A}{RUNS} select video_id, case label when 1 then 'click' when 2 then 'error' when 3 then 'purchase' else 'Unknown(4)' end category, s as "start", e as "end" from runs where label <> 0""")
def win_bouts(spark, d):
    r = R.runs(X.annot(spark, d).withColumn("label", F.when(F.col("label") == 0, 255).otherwise(F.col("label"))), "label")
    return K.bout_names(r, dict(enumerate(NAMES[:4])))


@query("agg_composition", f"{A}, b as (select label, 100.0::double * count(*) / (select count(*) from annot) p from annot group by all), a as (select case when label = 4 then 1 else label end label, 100.0::double * count(*) / (select count(*) from annot) p from annot group by all) select coalesce(a.label, b.label) as label, round(coalesce(b.p, 0), 6) as before, round(coalesce(a.p, 0), 6) as after, round(coalesce(a.p, 0) - coalesce(b.p, 0), 6) as delta from a full join b on a.label = b.label")
def composition(spark, d):
    a = X.annot(spark, d)
    out = K.composition(a, a.withColumn("label", F.when(F.col("label") == 4, 1).otherwise(F.col("label"))))
    return out.select("label", R6("before"), R6("after"), R6("delta"))


# --- reviews, overlays, second inferences ---

DECIDED = "dec as (select video_id, frame, case when animal_count = 1 then 1 when animal_count = 0 then 2 else 0 end status from blobs)"


def decisions(spark, d):
    return X.blobs(spark, d).select("video_id", "frame", F.when(F.col("animal_count") == 1, 1).when(F.col("animal_count") == 0, 2).otherwise(0).alias("status"))


def moved(p, by):
    return p.withColumn("kps", F.transform("kps", lambda k: F.struct((k["x"] + by).alias("x"), k["y"].alias("y"), k["conf"].alias("conf"))))


@query("join_review_merge", f"{LB}, {DECIDED} select video_id, frame, instance, keypoint, case when status = 1 then x + 2 else x end x, y from pose_long left join dec using (video_id, frame)")
def review_merge(spark, d):
    p = X.pose(spark, d)
    return P.to_long(K.reviewed(p, moved(p, 2.0), decisions(spark, d))).select(*KEYS, "keypoint", "x", "y")


@query("join_review_lists", f"{LB}, {DECIDED} select video_id, frame, case status when 1 then 'approved' when 2 then 'rejected' else 'marked' end category from dec")
def review_lists(spark, d):
    return K.review_marks(decisions(spark, d).select("video_id", "frame", F.lit("marked").alias("category")), decisions(spark, d))


@query("join_label_overlay", f"{LB}, {DECIDED} select video_id, frame, instance, keypoint, case status when 1 then x + 7 when 2 then x + 3 else x end x, y from pose_long left join dec using (video_id, frame)")
def label_overlay(spark, d):
    """Labels (moved by 3) of the frames with status 1 and 2 over the predictions; refined frames (status 1) are then saved from predictions moved by 7."""
    p, dec = X.pose(spark, d), decisions(spark, d)
    labels = moved(p.join(dec.where("status > 0").select("video_id", "frame"), ["video_id", "frame"], "left_semi"), 3.0)
    saved = K.saved_labels(labels, moved(p, 7.0), dec.where("status = 1"))
    return P.to_long(K.overlay(p, saved)).select(*KEYS, "keypoint", "x", "y")


@query("join_overlay_lists", f"{MARKS}, {L[5:]}, s as (select distinct video_id, frame from pose_long) select distinct m.video_id, m.frame, m.category from marks m left join s using (video_id, frame) where m.category <> 'labeled' and s.frame is null union select video_id, frame, 'labeled' from s")
def overlay_lists(spark, d):
    return K.overlay_marks(marks(spark, d), X.pose(spark, d))


@query("join_remap_infer", f"{LB}, f as (select video_id, frame, row_number() over (partition by video_id order by frame) - 1 pos from blobs where animal_count >= 2), n as (select *, dense_rank() over (partition by video_id order by frame) - 1 pos from pose_long where frame % 2 = 0) select f.video_id, f.frame, n.instance, n.keypoint, n.x + 10 as x, n.y + 20 as y from f left join n using (video_id, pos)")
def remap(spark, d):
    """New poses, here those of the even frames, in order; too few of them for the listed frames."""
    p = X.pose(spark, d).where("frame % 2 = 0")
    new = p.withColumn("position", (F.dense_rank().over(R.Window.partitionBy("video_id").orderBy("frame")) - 1).cast("bigint")).drop("frame")
    crop = p.select("video_id").distinct().select("video_id", F.lit(10.0).alias("x1"), F.lit(20.0).alias("y1"))
    out = K.remapped(new, X.blobs(spark, d).where("animal_count >= 2"), crop)
    rows = out.select(*KEYS, F.posexplode_outer("kps").alias("keypoint", "p")).select(*KEYS, "keypoint", "p.x", "p.y")
    return rows.where("instance is null or x is not null")


# --- detectors: second modes ---

@query("out_confidence_kp", f"{L} select video_id, frame, instance, keypoint from pose_long where conf < 0.4")
def confidence_kp(spark, d):
    return P.out_confidence_kp(X.pose(spark, d), 0.4)


@query("out_bone_ignored", f"{L}{BONE} select distinct video_id, frame, instance from bad where not (ka = 1 and kb = 3)")
def bone_ignored(spark, d):
    return P.out_bone(X.pose(spark, d), X.BONES, 2.0, ignored=((3, 1),)).where("out").select(*KEYS)


@query("out_jump_aligned", f"{L}{ALIGN} select a.video_id, a.frame, a.instance, a.keypoint from al a join al b on a.video_id = b.video_id and a.instance = b.instance and a.keypoint = b.keypoint and b.frame = a.frame - 1 where sqrt((a.ax - b.ax) ** 2 + (a.ay - b.ay) ** 2) > 25")
def jump_aligned(spark, d):
    """Jumps in body coordinates: aligned about the centroid."""
    return P.out_jump_kp(P.aligned(X.pose(spark, d), 0, 1, 2).select(*KEYS, "kps"), 25.0)


@query("out_combine", f"{LB}, {INST} select i.video_id, i.frame, i.instance from inst i join blobs b using (video_id, frame) where animal_count = 2 and c < 0.5 and n < 4")
def combine(spark, d):
    """Both masks, on marked frames."""
    p = X.pose(spark, d)
    return K.combined([p.where(P.out_confidence(0.5)), p.where(P.out_bodypart(4))], every=True, frames=X.blobs(spark, d).where("animal_count = 2"))


@query("mrk_outlier", f"{L}, {INST} select distinct video_id, frame from inst where (c < 0.4 or n < 4) and frame between 100 and 500")
def mark_outlier(spark, d):
    """Frames of the range that any of two detectors flags."""
    p = X.pose(spark, d)
    return K.combined([p.where(P.out_confidence(0.4)), p.where(P.out_bodypart(4))]).where("frame between 100 and 500").select("video_id", "frame").distinct()


# --- tones in L, A, B ---

_LIN = "case when {c} / 255.0::double > 0.04045 then power(({c} / 255.0::double + 0.055) / 1.055, 2.4) else {c} / 255.0::double / 12.92 end"
_F = "case when {t} > 0.008856 then cbrt({t}) else 7.787 * {t} + 16.0::double / 116 end"
LAB = f"""{PIXELS}, li as (select video_id, frame, x as px, y as py, {", ".join(f"{_LIN.format(c=c)} as l{c}" for c in "rgb")} from px),
xyz as (select video_id, frame, px, py, {", ".join(f"({m[0]} * lr + {m[1]} * lg + {m[2]} * lb) / {w} as {n}" for n, m, w in zip("xyz", G._XYZ.tolist(), G._WHITE.tolist(), strict=True))} from li),
lab as (select video_id, frame, px, py, cast(least(greatest(floor(case when y > 0.008856 then 116 * cbrt(y) - 16 else 903.3 * y end * 255 / 100 + 0.5), 0), 255) as integer) l, cast(least(greatest(floor(500 * ({_F.format(t='x')} - {_F.format(t='y')}) + 128.5), 0), 255) as integer) a, cast(least(greatest(floor(200 * ({_F.format(t='y')} - {_F.format(t='z')}) + 128.5), 0), 255) as integer) b from xyz)"""


_BRIGHT = ", ".join(f"cast(least(round_even(abs({c} * 1.25::double - 20), 0), 255) as integer) {c}" for c in "bgr")


@query("img_tone_apply", f"{LAB.replace(' from px)', f' from (select video_id, frame, x, y, {_BRIGHT} from px))', 1)} select video_id, frame, px as x, py as y, least(greatest(l + 9, 0), 255) l, least(greatest(a - 4, 0), 255) as a, least(greatest(b + 2, 0), 255) b from lab")
def tone_apply(spark, d):
    """Contrast and brightness in B, G, R, then L, A, B moved."""
    return G.unpacked(G.toned(images(spark, d), 1.25, -20.0, (9, -4, 2)), ("l", "a", "b"))


@query("agg_tone_hist", f"""{LAB}, ch as ({" union all ".join(f"select video_id, frame, '{c}' c, {c} v from lab" for c in "lab")}), bn as (select video_id, frame, c, k, count(*) filter (where v // 32 = k) n from ch, range(8) t(k) group by all),
nm as (select *, coalesce((n - min(n) over w) / nullif(cast(max(n) over w - min(n) over w as double), 0), 0) t from bn window w as (partition by video_id, frame, c)), rf as (select video_id, c, k, avg(t) q from nm where frame % 10 = 0 group by all),
ds as (select video_id, frame, c, sqrt(greatest(0, 1 - sum(sqrt(t * q)) / case when sum(t) * sum(q) > 0 then sqrt(sum(t) * sum(q)) else 1 end)) a from nm join rf using (video_id, c, k) group by all) select video_id, frame, round(avg(a), 6) distance, round(avg(a), 6) >= 0.1 kept from ds group by all""")
def tone_hist(spark, d):
    i = images(spark, d)
    return G.tone_distance(G.tones(i), i.where("frame % 10 = 0").select("video_id", "frame")).select("video_id", "frame", R6("distance"), (F.round("distance", 6) >= 0.1).alias("kept"))
