"""Counts over streams of labelled events, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posetrail.operators.lineage import scratch


def windowed_counts(events: DataFrame, time: str, kind: str, every: str = "1 hour", late: str = "30 days") -> DataFrame:
    """(start, kind, n) of tumbling windows of event time; rows later than the watermark are dropped, and the state of closed windows goes."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    counts = timed.groupBy(F.window(time, every).alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), "kind", "n")


def settled(spark: SparkSession, stream: DataFrame, keys: list[str], name: str = "stream") -> DataFrame:
    """What a stream of updates comes to once all that is there has been read: the last row of each key. Batches go to the shared folder;
    the query's own checkpoint lies beside them, so a restart goes on where it stopped."""
    path = scratch(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/number={number}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    last = rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch"))))
    return last.where("r = 1").select(*stream.columns)
