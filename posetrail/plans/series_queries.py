"""Queries over count and label series, marks, samples and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from posetrail.operators import learning as E_
from posetrail.operators import numbers as N
from posetrail.operators import runs as R
from posetrail.operators import stitch
from posetrail.operators.lineage import cut
from posetrail.plans import fixtures as X
from posetrail.plans.registry import query

A, B, AB, E = f"with {X.ANNOT_SQL}", f"with {X.BLOB_SQL}", f"with {X.ANNOT_SQL}, {X.BLOB_SQL}", f"with {X.EMB_SQL}"
V = "window w as (partition by video_id order by frame)"
RUNS = f", r0 as (select *, case when lag(label) over w is distinct from label then 1 else 0 end c from annot {V}), r1 as (select *, sum(c) over w r from r0 {V}), runs as (select video_id, r, label, min(frame) s, max(frame) e, count(*) n from r1 group by all)"
NAMES = ["other", "click", "error", "purchase", "signup"]


def annot(name, make, sql):
    query(name, f"{A}{sql}")(lambda spark, d: make(X.annot(spark, d)))


def marks(name, make, sql):
    query(name, f"with {X.MARKS_SQL}{sql}")(lambda spark, d: make(X.marks(spark, d)))


def blob(name, make, sql):
    query(name, f"{B}{sql}")(lambda spark, d: make(X.blobs(spark, d)))


def last(df):
    return df.groupBy("video_id").agg(F.max("frame").alias("last"))


annot("win_runs", lambda a: R.runs(a, "label"), f'{RUNS} select video_id, label, s as "start", e as "end", n as length from runs')
annot("win_bout_starts", lambda a: R.changes(a, "label", first=True), f"{RUNS} select video_id, s as frame from runs")
annot("win_next_change", lambda a: R.next_change(a, "label").select("video_id", "frame", "next"), f"{RUNS} select a.video_id, a.frame, r.e + 1 as next from annot a join runs r on a.video_id = r.video_id and a.frame between r.s and r.e")
annot("win_annotate_fill", lambda a: R.annotate_fill(a.select("video_id", "frame", "label"), a.where("frame % 10 = 3").select("video_id", "frame", F.lit(9).alias("new"))), f"{RUNS}, e as (select a.video_id, a.frame f, r.e t from annot a join runs r on a.video_id = r.video_id and a.frame between r.s and r.e where a.frame % 10 = 3) select video_id, frame, cast(case when exists (select 1 from e where e.video_id = a.video_id and a.frame between f and t) then 9 else label end as integer) label from annot a")
annot("win_segment_neutral", lambda a: R.runs(a.withColumn("neutral", F.col("label").isin(0, 2)), "neutral").where("not neutral").select("video_id", "start", "end"), f', n0 as (select *, label in (0, 2) neutral from annot), r0 as (select *, case when lag(neutral) over w is distinct from neutral then 1 else 0 end c from n0 {V}), r1 as (select *, sum(c) over w r from r0 {V}) select video_id, min(frame) "start", max(frame) "end" from r1 where not neutral group by video_id, r')
annot("win_bout_cluster", lambda a: R.bout_clusters(a, "label", 5).select("video_id", "label", F.col("cluster").cast("bigint").alias("cluster"), "size", F.round("centre", 6).alias("centre")), ", g as (select *, case when frame - lag(frame) over x > 5 or lag(frame) over x is null then 1 else 0 end c from annot window x as (partition by video_id, label order by frame)), h as (select *, cast(sum(c) over (partition by video_id, label order by frame) as bigint) cluster from g) select video_id, label, cluster, count(*) size, round(avg(frame), 6) centre from h group by all")


@query("agg_segment_stats", f"{A}{RUNS} select quantile_cont(n, 0.5)::double median, round(avg(n), 6) mean, min(n) least, max(n) most from runs")
def segment_stats(spark, d):
    lengths = cut(R.runs(X.annot(spark, d), "label").select("length"))
    (median,) = N.quantiles(lengths, "length", (0.5,))
    return lengths.agg(F.lit(median).cast("double").alias("median"), F.round(F.avg("length"), 6).alias("mean"), F.min("length").alias("least"), F.max("length").alias("most"))


@query("agg_segment_lengths", f"{A}{RUNS} select n as length, count(*) segments from runs group by all")
def segment_lengths(spark, d):
    return R.runs(X.annot(spark, d), "label").groupBy("length").agg(F.count(F.lit(1)).alias("segments"))


@query("agg_area_hist", f"""{A}, s as (select * from annot where frame % 3 = 0), h as (select 1.2 * quantile_cont(area, 0.99) + 500 hi, 0.95 * min(area) as lo from s)
select cast(least(floor(area / (hi / 100)), 99) as bigint) bin, count(*) n, any_value(round(lo, 6)) as x_min from s, h where area >= 0 and area <= hi group by all""")
def area_hist(spark, d):
    """Every third frame is the feature's own sample."""
    sampled = X.annot(spark, d).where("frame % 3 = 0").select("area")
    return N.area_histogram(sampled, "area")


annot("win_agree_roll", lambda a: a.withColumn("m", F.avg((F.col("label") == 0).cast("double")).over(R.video().rangeBetween(-3, 3))).select("video_id", "frame", F.round("m", 6).alias("m"), F.when(F.col("m") > 0.6, 2).when(F.col("m") < 0.4, 1).otherwise(0).alias("class")), ", m as (select video_id, frame, avg(case when label = 0 then 1.0 else 0.0 end) over (partition by video_id order by frame range between 3 preceding and 3 following) m from annot) select video_id, frame, round(m, 6) m, cast(case when m > 0.6 then 2 when m < 0.4 then 1 else 0 end as integer) class from m")
annot("ann_remove_category", lambda a: a.select("video_id", "frame", F.when(F.col("label") == 2, 0).when(F.col("label") > 2, F.col("label") - 1).otherwise(F.col("label")).alias("label")), " select video_id, frame, cast(case when label = 2 then 0 when label > 2 then label - 1 else label end as integer) label from annot")
annot("ann_from_frames", lambda a: a.select("video_id", "frame", F.explode(F.array("label", (F.col("frame") % 3).cast("int"))).alias("l")).groupBy("video_id", "frame").agg(F.max("l").alias("label")), " select video_id, frame, cast(greatest(label, frame % 3) as integer) label from annot")
annot("join_span_frames", lambda a: R.runs(a, "label").select("video_id", F.explode(F.sequence("start", "end")).alias("frame"), "start", "end"), f'{RUNS} select a.video_id, a.frame, r.s as "start", r.e as "end" from annot a join runs r on a.video_id = r.video_id and a.frame between r.s and r.e')
annot("join_nearest_mark", lambda a: R.nearest_marks(a.select("video_id", "frame"), a.where("label = 3")), ", m as (select *, case when label = 3 then frame end mk from annot) select video_id, frame, last_value(mk ignore nulls) over (partition by video_id order by frame rows between unbounded preceding and 1 preceding) previous, first_value(mk ignore nulls) over (partition by video_id order by frame rows between 1 following and unbounded following) following from m")
annot("snk_frame_list", lambda a: a.where("label in (3, 4)").groupBy("video_id").agg(F.array_join(F.sort_array(F.collect_set("frame")), ", ").alias("frames")), " select video_id, string_agg(cast(frame as varchar), ', ' order by frame) frames from annot where label in (3, 4) group by all")
annot("smp_stride", lambda a: a.where("(frame - 2) % 7 = 0 and frame >= 2").select("video_id", "frame"), " select video_id, frame from annot where (frame - 2) % 7 = 0 and frame >= 2")
annot("smp_linspace", lambda a: R.evenly(a.select("video_id", "frame"), 10), ", n as (select *, count(*) over (partition by video_id) n, row_number() over (partition by video_id order by frame) - 1 r from annot) select video_id, frame from n where n <= 10 or r in (select cast(floor(i * (n.n - 1) / 9.0) as bigint) from generate_series(0, 9) t(i))")
annot("smp_chunks", lambda a: R.chunks(a.select("video_id", "frame"), 20), " select video_id, frame, cast((row_number() over (partition by video_id order by frame) - 1) // 20 as bigint) chunk from annot")
annot("smp_segment_even", lambda a: R.runs(a, "label").where("length >= 2").withColumn("r", F.row_number().over(Window.partitionBy("video_id").orderBy("start"))).where("r % 2 = 1").select("video_id", "start", "length"), f'{RUNS} select video_id, s as "start", n as length from (select *, row_number() over (partition by video_id order by s) q from runs where n >= 2) where q % 2 = 1')
annot("set_union_any", lambda a: a.where("label in (1, 2)").select("video_id", "frame").distinct(), " select distinct video_id, frame from annot where label in (1, 2)")
marks("set_intersect_all", lambda m: m.where("category in ('active', 'large')").groupBy("video_id", "frame").agg(F.count_distinct("category").alias("n")).where("n = 2").select("video_id", "frame"), " select video_id, frame from marks where category = 'active' intersect select video_id, frame from marks where category = 'large'")
marks("set_except", lambda m: m.where("category = 'active'").select("video_id", "frame").join(m.where("category <> 'active'").select("video_id", "frame"), ["video_id", "frame"], "left_anti"), " select video_id, frame from marks where category = 'active' except select video_id, frame from marks where category <> 'active'")
marks("agg_dup_entries", lambda m: m.groupBy("video_id", "frame").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), " select video_id, frame, count(*) n from marks group by all having count(*) > 1")
annot("set_add_remove", lambda a: a.where("label = 1").select("video_id", "frame").union(a.where("label = 2").select("video_id", "frame")).distinct().join(a.where("frame % 5 = 0").select("video_id", "frame"), ["video_id", "frame"], "left_anti"), " select video_id, frame from annot where label in (1, 2) and frame % 5 <> 0")
annot("set_len", lambda a: a.groupBy("label").agg(F.count(F.lit(1)).alias("n")), " select label, count(*) n from annot group by all")
annot("mrk_resolve", lambda a: R.resolve(a.select("video_id", "frame", F.explode(F.array(F.lit("marked"), F.when(F.col("label") == 1, "labeled"), F.when(F.col("label") == 2, "merged"))).alias("category")).where("category is not null"), {"marked": 1, "labeled": 2, "merged": 3}), " select video_id, frame, case label when 1 then 'labeled' when 2 then 'merged' else 'marked' end category from annot")
annot("mrk_apply", lambda a: R.apply_marks(a.where("label = 1").select("video_id", "frame"), a.where("label = 2").select("video_id", "frame"), "COMBINE", a.where("frame % 7 = 0").select("video_id", "frame")), " select video_id, frame from annot where label in (1, 2) and frame % 7 <> 0")
annot("mrk_clipboard", lambda a: a.groupBy("video_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("frame")), lambda f: f.cast("string")), ", ").alias("t")).select("video_id", F.explode(F.split("t", r"[,\s]+")).alias("v")).select("video_id", F.expr("try_cast(v as bigint)").alias("frame")).where("frame between 5 and 20").distinct(), " select video_id, frame from annot where frame between 5 and 20")
annot("scl_json_meta", lambda a: R.runs(a, "label").select("video_id", F.to_json(F.struct("start", "end", "label")).alias("j")).select("video_id", F.from_json("j", "start bigint, end bigint, label int").alias("s")).select("video_id", "s.start", "s.end", "s.label"), f'{RUNS} select video_id, s as "start", e as "end", label from runs')
annot("scl_img_path", lambda a: a.select("video_id", "frame", F.concat(F.lit("labeled-data/v"), F.col("video_id"), F.lit("/img"), F.lpad(F.col("frame").cast("string"), 8, "0"), F.lit(".png")).alias("path")).select("path", F.regexp_extract("path", r"img(\d+)\.png", 1).cast("bigint").alias("frame"), F.element_at(F.split("path", "[/\\\\]"), 2).alias("folder")), " select 'labeled-data/v' || video_id || '/img' || lpad(cast(frame as varchar), 8, '0') || '.png' path, frame, 'v' || video_id folder from annot")
annot("scl_seconds", lambda a: a.select("video_id", "frame", F.round(F.col("frame") / 30, 6).alias("seconds"), F.floor(F.col("area") + 0.5).cast("bigint").alias("rounded"), F.round(1 / (1 + F.exp(-(F.col("label") - 2.0))), 6).alias("sigmoid"), F.least(F.greatest(F.col("area"), F.lit(1.0)), F.lit(50.0)).alias("clipped")), ' select video_id, frame, round(frame / 30.0::double, 6) as "seconds", cast(floor(area + 0.5) as bigint) as rounded, round(1 / (1 + exp(-(label - 2.0::double))), 6) as sigmoid, least(greatest(area, 1.0::double), 50.0::double) as clipped from annot')


# a pass: short inner bouts look at their neighbours as the pass found them, and equal neighbours merge; videos without a short one stop
@query("win_short_bout", f"""{A.replace('with ', 'with recursive ', 1)}{RUNS}, st as (select 0 as pass, video_id, s, e, label v from runs
union all select pass + 1, video_id, min(s), max(e), v from (select *, sum(ch) over (partition by pass, video_id order by s) q from (select *, case when lag(v) over w is distinct from v then 1 else 0 end ch from (
select pass, video_id, s, e, last_value(case when not short then v0 when n_left < n_right then v_right end ignore nulls) over (partition by pass, video_id order by s rows between unbounded preceding and current row) v from (
select *, max(short::int) over (partition by pass, video_id) open from (select *, n < 3 and n_left is not null and n_right is not null short from (
select pass, video_id, s, e, v v0, e - s + 1 n, lag(e - s + 1) over w n_left, lead(e - s + 1) over w n_right, lead(v) over w v_right from st window w as (partition by pass, video_id order by s)))) where open = 1) window w as (partition by pass, video_id order by s))) group by pass, video_id, q, v)
select video_id, s as "start", e as "end", v as label from (select *, max(pass) over (partition by video_id) m from st) where pass = m""")
def short_bout(spark, d):
    return R.short_bouts(X.annot(spark, d), "label", 3)


blob("win_change_buffer", lambda b: R.buffered(R.changes(b, "animal_count"), 5, last(b)), f", ch as (select video_id, frame from (select *, lag(animal_count) over w b from blobs {V}) where b <> animal_count), l as (select video_id, max(frame) last from blobs group by all) select distinct video_id, unnest(generate_series(greatest(frame - 5, 0), least(frame + 5, last))) as frame from ch join l using (video_id)")
blob("agg_blob_categories", lambda b: b.select("video_id", "frame", F.explode(F.filter(F.array(F.when(F.col("animal_count") == 0, "0").when(F.col("animal_count") == 1, "1").otherwise("2+"), F.when(F.col("merged") == 1, "merged")), lambda v: v.isNotNull())).alias("category")), " select video_id, frame, case animal_count when 0 then '0' when 1 then '1' else '2+' end category from blobs union all select video_id, frame, 'merged' from blobs where merged = 1")
blob("mrk_animal_num", lambda b: b.where("animal_count in (0, 1) or merged = 1").select("video_id", "frame"), " select video_id, frame from blobs where animal_count in (0, 1) or merged = 1")
blob("join_last_nonempty", lambda b: R.last_nonempty(b, "animal_count"), " select video_id, frame, coalesce(max(case when animal_count > 0 then frame end) over (partition by video_id order by frame range between 10 preceding and 1 preceding), frame - 1) source from blobs")
blob("win_stable_single", lambda b: R.runs(b.withColumn("single", F.col("animal_count") == 1), "single").where("single and length >= 5").select("video_id", "start", "end"), f', r0 as (select *, animal_count = 1 single, case when lag(animal_count = 1) over w is distinct from (animal_count = 1) then 1 else 0 end c from blobs {V}), r1 as (select *, sum(c) over w r from r0 {V}) select video_id, min(frame) "start", max(frame) "end" from r1 where single group by video_id, r having count(*) >= 5')
blob("mrk_infer_nm", lambda b: b.where("animal_count >= 2").select("video_id", "frame").union(R.buffered(R.changes(b, "animal_count"), 20, last(b)).join(b.where("animal_count >= 2").select("video_id").distinct(), "video_id", "left_semi").select("video_id", "frame")).union(b.where("frame % 10 = 0").select("video_id", "frame")).distinct(), f", ch as (select video_id, frame from (select *, lag(animal_count) over w b from blobs {V}) where b <> animal_count), l as (select video_id, max(frame) last from blobs group by all) select video_id, frame from blobs where animal_count >= 2 union select video_id, unnest(generate_series(greatest(frame - 20, 0), least(frame + 20, last))) as frame from ch join l using (video_id) union select video_id, frame from blobs where frame % 10 = 0")


@query("win_bout_stitch")
def bout_stitch(spark, d):
    """Label 0 is the neutral one; tests hold the layout against a walk over frames."""
    return stitch.stitched(X.annot(spark, d).select("video_id", "frame", "label"), "label", (0,))


def _settled(v, on):
    """Frames with a base value and whether they lie near a longer run of ``on``, or follow such a run as single frames."""
    return f"""{v}0 as (select *, case when lag({v}) over w is distinct from {v} then 1 else 0 end f from bs {V}), {v}1 as (select *, sum(f) over w r from {v}0 {V}), {v}2 as (select video_id, r, {v} v, min(frame) s, max(frame) e, count(*) n from {v}1 group by all),
{v}3 as (select *, case when n > 1 then v else coalesce(last_value(case when n > 1 then v end ignore nulls) over up, last_value(v) over whole) end base, max(case when n > 1 and v = {on} then e + 5 end) over up reach, min(case when n > 1 and v = {on} then s - 5 end) over down nxt, last_value(case when n > 1 then e end ignore nulls) over up bef from {v}2
    window up as (partition by video_id order by s rows between unbounded preceding and current row), down as (partition by video_id order by s rows between current row and unbounded following), whole as (partition by video_id order by s rows between unbounded preceding and unbounded following)),
{v}4 as (select a.video_id, a.frame, base, coalesce(frame <= reach, false) or coalesce(frame >= nxt, false) near, n = 1 and coalesce(bef <= reach, false) follows from {v}1 a join {v}3 b on a.video_id = b.video_id and a.r = b.r)"""


@query("win_blob_clean", f"""{B}, bs as (select video_id, frame, least(animal_count, 2) c, merged m from blobs), {_settled('c', 2)}, {_settled('m', 1)}
select video_id, frame, cast(case when k.near or k.follows or k.base = 1 then 2 when j.near then 2 else j.base end as integer) animal_count, cast(k.near or k.follows or k.base = 1 as integer) merged from c4 j join m4 k using (video_id, frame)""")
def blob_clean(spark, d):
    return R.blob_clean(X.blobs(spark, d))


@query("agg_sim_stats", f"""{E}, n as (select *, sqrt(list_sum(list_transform(embedding, lambda v: v::double * v::double))) z from emb), p as (select a.segment, a.motion_id = b.motion_id same, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda v: v[1]::double * v[2]::double)) / (a.z * b.z) s from n a join n b on a.segment = b.segment and a.vec_id < b.vec_id)
select segment, same, count(*) n, round(avg(s), 6) mean, round(quantile_cont(s, 0.3), 6) p30, round(quantile_cont(s, 0.7), 6) p70 from p group by all""")
def sim_stats(spark, d):
    p = E_.pair_statistics(X.embeddings(spark, d))
    return p.select("segment", "same", "n", *(F.round(c, 6).alias(c) for c in ("mean", "p30", "p70")))


@query("scl_array_norm", f"{E} select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda v: v::double * v::double))), 6) norm from emb")
def array_norm(spark, d):
    return X.embeddings(spark, d).select("vec_id", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v)), 6).alias("norm"))
