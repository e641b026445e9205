"""An extension: mergeable group statistics over event streams, in tumbling windows with a watermark.

The batch operators' sums (SEL1) are associative, so the same aggregation serves a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of the folder as a stream, one file a trigger."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Per window and event type, count, sum and sum of squares; rows later than ``late`` behind the newest are left out of a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    g = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("value").alias("n"), F.sum("value").alias("sum_x"), F.sum(F.col("value") ** 2).alias("sum_x2"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "sum_x", "sum_x2")


def run_once(spark: SparkSession, source: str, checkpoint: str, table: str) -> DataFrame:
    """Everything that is there, through the stream, as the in-memory table ``table``."""
    query = windowed(event_stream(spark, source)).writeStream.format("memory").queryName(table).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(table)
