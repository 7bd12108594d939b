"""Streaming surface: an addition, as the batch operators have no stream of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of a folder as a stream, with the schema that its present files have."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def _timed(events: DataFrame, time: str) -> DataFrame:
    """Watermarks need a timestamp with a zone; a naive one is read in the session's (UTC)."""
    return events.withColumn(time, F.col(time).cast("timestamp"))


def windowed_bars(events: DataFrame, key: str, time: str, value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Open, high, low, close and count per key and window; rows later than ``late`` are dropped by the watermark."""
    v, t = F.col(value), F.col(time)
    x = _timed(events, time).withWatermark(time, late).groupBy(F.window(t, width).alias("w"), F.col(key).alias("series"))
    bars = x.agg(F.min_by(v, t).alias("open"), F.max(v).alias("high"), F.min(v).alias("low"), F.max_by(v, t).alias("close"), F.count("*").cast("double").alias("volume"))
    return bars.select("series", F.col("w.start").alias("d"), "open", "high", "low", "close", "volume")


def sessions(events: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    x = _timed(events, time).withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), F.col(key).alias("series"))
    return x.agg(F.count("*").alias("n")).select("series", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain what is there into a table in memory and return it."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
