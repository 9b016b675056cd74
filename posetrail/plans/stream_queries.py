"""Queries over streams of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from posetrail.plans.registry import query
from posetrail.streaming import counts as C


@query("stream_label_counts", "select epoch(date_trunc('day', ts))::bigint as day, event_type as kind, count(*) n from events group by all")
def label_counts(spark, d):
    """Events as a stream of files, counted by day and type; updates come together in the last row of each window."""
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    counted = C.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 day", "3650 days")
    out = C.settled(spark, counted, ["start", "kind"])
    return out.select(F.unix_timestamp("start").alias("day"), "kind", "n")
