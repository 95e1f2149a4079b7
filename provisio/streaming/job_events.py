"""Job events as a stream: windowed counts with a watermark, and the state of each job."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_counts(events: DataFrame, window: str = "1 day", late: str = "3 days") -> DataFrame:
    """Counts and sums by window and type; events later than the watermark are left out of a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs an instant
    seen = timed.withWatermark("ts", late) if events.isStreaming else timed
    grouped = seen.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def run_available(spark: SparkSession, source: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what its source holds now, into Parquet below folder; what it wrote.

    The checkpoint stands beside the output, so a run that was cut off goes on where it stopped, each window once.
    """
    name = uuid.uuid4().hex
    out, state = f"{folder}/stream-{name}", f"{folder}/state-{name}"
    query = source.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(source.schema).parquet(out)
