"""Structured Streaming over the events table: windowed metrics, sessions and job states, each with a batch twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW, WATERMARK, SESSION = "5 minutes", "10 minutes", "30 minutes"


def stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Events as they arrive in a folder of Parquet files, with an event time that watermarks accept."""
    return timed(spark.readStream.schema(schema).parquet(path))


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("at", F.col("ts").cast("timestamp"))


def _counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 9).alias("mean"), F.count_if(F.col("event_type") == "error").alias("errors")]


def windowed(events: DataFrame, window: str = WINDOW) -> DataFrame:
    """start, n, mean, errors of each tumbling window. A stream drops events later than WATERMARK."""
    if events.isStreaming:
        events = events.withWatermark("at", WATERMARK)
    rows = events.groupBy(F.window("at", window)).agg(*_counts())
    return rows.select(F.col("window.start").alias("start"), "n", "mean", "errors")


def percentiles(events: DataFrame, window: str = WINDOW) -> DataFrame:
    """Exact percentiles, rate and shares of each window; batch only."""
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    rows = events.groupBy(F.window("at", window).alias("w")).agg(p.alias("p"), *_counts(), F.count_if(F.col("event_type") == "view").alias("views"))
    return rows.select(F.unix_seconds("w.start").alias("start"), "n", *(F.round(F.get("p", F.lit(i)), 6).alias(f"p{q}") for i, q in enumerate((50, 95, 99))), F.round(F.col("errors") / F.col("n"), 6).alias("error_rate"), F.round(F.col("views") / F.col("n"), 6).alias("hit_rate"))


def sessions(events: DataFrame, gap: str = SESSION) -> DataFrame:
    """user_id, start, upto, n of each user's sessions."""
    if events.isStreaming:
        events = events.withWatermark("at", WATERMARK)
    rows = events.groupBy("user_id", F.session_window("at", gap)).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("upto"), "n")


def latest_state(events: DataFrame) -> DataFrame:
    """The last event of each user, as a job's state, by time and then id."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("since"), F.count(F.lit(1)).alias("changes"))


def run_available(query: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a streaming query over what is there now and return what it has put out."""
    writer = query.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    return query.sparkSession.table(name)
