"""Scores of predictions as they arrive (an extension: no such stream exists elsewhere)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def prediction_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events as a stream of predictions; a glob, because the source takes no single file."""
    glob = path[:-1] + f"[{path[-1]}]"
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(glob).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_accuracy(predictions: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Per window and model: predictions and how many were right; windows close ``late`` after their end."""
    right = (F.col("value") > 50).cast("long")
    timed = predictions.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("model")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(right).alias("n_right")
    )


def run_to_end(stream: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """Process all that is there and return it (append mode: closed windows only)."""
    query = stream.writeStream.format("memory").queryName(table).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(table)
