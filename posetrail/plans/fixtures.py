"""Pose, count, label and embedding views that Spark derives from the given tables, and the same views in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posetrail.operators import pose as P

K = 4
BONES = [(0, 1), (1, 2), (1, 3)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pose_long(spark: SparkSession, sf_dir: str, dealt: tuple[str | Column, ...] = ()) -> DataFrame:
    """video_id, frame, instance, keypoint, x, y, conf; absent keypoints have no row. Rows are ``dealt`` by expressions of the first three,
    if any are given, before they become a row a keypoint: a fifth of the bytes."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity")
    first = li.groupBy("l_orderkey", (F.col("l_linenumber") % 2).alias("instance")).agg(
        F.min(F.struct("l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity")).alias("r")
    )
    b = first.select(
        F.expr("cast(l_orderkey div 2000 as bigint)").alias("video_id"), (F.col("l_orderkey") % 2000).cast("bigint").alias("frame"), F.col("instance").cast("int").alias("instance"),
        F.col("r.l_partkey").alias("pk"), F.col("r.l_suppkey").alias("sk"), F.col("r.l_quantity").alias("q"),
    )
    b = b.repartition(*dealt) if dealt else b
    b = b.withColumn("e", F.expr("case when ((frame div 100) % 5 = 3) <> (sk % 41 = 0) then 1 - instance else instance end"))
    points = F.array(*(F.struct(F.lit(k).alias("keypoint"), F.lit(ox).alias("ox"), F.lit(oy).alias("oy")) for k, ox, oy in ((0, 20, 0), (1, 0, 0), (2, -20, 0), (3, 14, 8))))
    rows = b.withColumn("p", F.explode(points)).select("*", "p.*").where("(pk + 7 * keypoint) % 11 <> 0")
    return rows.select(
        "video_id", "frame", "instance", "keypoint",
        F.expr("cast(100 + (3 * frame + 250 * e) % 1000 + ox + (pk * (keypoint + 3)) % 7 - 3 + case when keypoint = 0 and q = 50 then 150 else 0 end as double)").alias("x"),
        F.expr("cast(150 + 200 * e + (2 * frame) % 300 + oy + (sk * (keypoint + 2)) % 5 - 2 as double)").alias("y"),
        F.expr("cast((pk * (2 * keypoint + 1) + sk) % 101 as double) / 100").alias("conf"),
    )


def pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.to_arrays(pose_long(spark, sf_dir, ("video_id", "frame")), K, dealt=True)


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").selectExpr("cast(o_orderkey div 2000 as bigint) video_id", "cast(o_orderkey % 2000 as bigint) frame", "o_custkey")
    o = o.selectExpr("video_id", "frame", "case when o_custkey % 29 = 0 then 0 when (frame div 25) % 4 = 0 then 1 when (frame div 25) % 7 = 6 then 3 else 2 end animal_count")
    return o.selectExpr("video_id", "frame", "cast(animal_count as int) animal_count", "case when animal_count >= 2 and (frame div 40) % 3 = 0 then 1 else 0 end merged")


def annot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    label = F.create_map(*(F.lit(x) for kv in (("view", 0), ("click", 1), ("error", 2), ("purchase", 3), ("signup", 4)) for x in kv))
    return e.select(F.col("user_id").cast("bigint").alias("video_id"), (F.row_number().over(w) - 1).cast("bigint").alias("frame"), label[F.col("event_type")].alias("label"), F.col("value").alias("area"))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, category, frame): frames marked with up to three categories each."""
    kinds = F.array(F.when(F.col("label").isin(1, 2), "active"), F.when(F.col("area") > 50, "large"), F.when(F.col("frame") % 3 == 0, "third"))
    return annot(spark, sf_dir).select("video_id", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("category"), "frame")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.selectExpr("vec_id", "cast(vec_id div 50 as bigint) segment", "cast(vec_id div 2 as bigint) frame", "cast(vec_id % 2 as int) motion_id", "label", "cast(embedding as array<double>) embedding")


LONG_SQL = """first_rows as (select l_orderkey, l_linenumber % 2 as inst, l_partkey as pk, l_suppkey as sk, l_quantity as q,
    row_number() over (partition by l_orderkey, l_linenumber % 2 order by l_linenumber, l_extendedprice, l_partkey, l_suppkey, l_quantity) as rn from lineitem),
base as (select cast(l_orderkey // 2000 as bigint) as video_id, cast(l_orderkey % 2000 as bigint) as frame, cast(inst as integer) as instance, pk, sk, q from first_rows where rn = 1),
based as (select *, case when ((frame // 100) % 5 = 3) <> (sk % 41 = 0) then 1 - instance else instance end as e from base),
pose_long as materialized (select video_id, frame, instance, cast(k as integer) as keypoint,
    cast(100 + (3 * frame + 250 * e) % 1000 + ox + (pk * (k + 3)) % 7 - 3 + case when k = 0 and q = 50 then 150 else 0 end as double) as x,
    cast(150 + 200 * e + (2 * frame) % 300 + oy + (sk * (k + 2)) % 5 - 2 as double) as y,
    cast((pk * (2 * k + 1) + sk) % 101 as double) / 100 as conf
    from based cross join (values (0, 20, 0), (1, 0, 0), (2, -20, 0), (3, 14, 8)) t(k, ox, oy) where (pk + 7 * k) % 11 <> 0)"""

BLOB_SQL = """blob0 as (select cast(o_orderkey // 2000 as bigint) as video_id, cast(o_orderkey % 2000 as bigint) as frame, o_custkey from orders),
blob1 as (select video_id, frame, cast(case when o_custkey % 29 = 0 then 0 when (frame // 25) % 4 = 0 then 1 when (frame // 25) % 7 = 6 then 3 else 2 end as integer) as animal_count from blob0),
blobs as (select *, cast(case when animal_count >= 2 and (frame // 40) % 3 = 0 then 1 else 0 end as integer) as merged from blob1)"""

ANNOT_SQL = """annot as (select cast(user_id as bigint) as video_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as frame,
    cast(case event_type when 'view' then 0 when 'click' then 1 when 'error' then 2 when 'purchase' then 3 when 'signup' then 4 end as integer) as label, value as area from events)"""

EMB_SQL = """emb as (select vec_id, cast(vec_id // 50 as bigint) as segment, cast(vec_id // 2 as bigint) as frame, cast(vec_id % 2 as integer) as motion_id, label, embedding from embeddings)"""

MARKS_SQL = f"""{ANNOT_SQL}, marks as (select video_id, 'active' as category, frame from annot where label in (1, 2) union all select video_id, 'large', frame from annot where area > 50 union all select video_id, 'third', frame from annot where frame % 3 = 0)"""
