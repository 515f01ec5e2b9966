"""Structured Streaming over events: session traces, windowed token counts, rules on live traces.

State is bounded by the watermark: what arrives later than ``late`` is dropped by Spark and counted
in its progress reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.traces import compressed

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A folder that receives Parquet files of events."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def session_traces(events: DataFrame, key: str = "user_id", token: str = "event_type", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A trace for each run of a key's events without a longer gap: key, start, end, event_sequence, compressed, n."""
    own = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key)
    seq = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.col(token).alias("t")))), lambda x: x["t"])
    return own.agg(seq.alias("event_sequence"), F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_sequence", compressed("event_sequence").alias("compressed"), "n")


def token_rates(events: DataFrame, token: str = "event_type", width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, end, token, n in tumbling or sliding windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), F.col(token).alias("token")).agg(F.count("*").alias("n")).select("w.start", "w.end", "token", "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Events without repeats of their keys, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
