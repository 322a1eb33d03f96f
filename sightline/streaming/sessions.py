"""Sessions, windowed counts and pair matching on streams; ts is a timestamp. Late rows beyond the watermark are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "10 seconds"


def sessions(rows: DataFrame, keys: list[str], gap_micros: int, late: str = LATE) -> DataFrame:
    """Runs of rows less than gap apart. Spark joins rows exactly one gap apart, so a microsecond is taken off."""
    held = rows.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", f"{gap_micros - 1} microseconds").alias("w"))
    return held.agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("rows")).drop("w")


def tumbling_counts(gestures: DataFrame, seconds: int = 40, late: str = LATE) -> DataFrame:
    """Gestures of each kind in windows of 40 seconds."""
    return gestures.withWatermark("ts", late).groupBy("video_id", F.window("ts", f"{seconds} seconds").alias("w"), "gesture_type").agg(F.count("*").alias("n")).select("video_id", F.col("w.start").alias("window_start"), "gesture_type", "n")


def pairs(gaze: DataFrame, gestures: DataFrame, reach: int = 3, late: str = LATE) -> DataFrame:
    """Gaze events and gestures of a video that start within reach seconds of each other: a stream-stream join with bounded state."""
    a = gaze.withWatermark("ts", late).select("video_id", F.col("ts").alias("gaze_ts"), "event_id")
    b = gestures.withWatermark("ts", late).select(F.col("video_id").alias("v"), F.col("ts").alias("gesture_ts"), "gesture_key")
    near = F.expr(f"gesture_ts BETWEEN gaze_ts - INTERVAL {reach} SECONDS AND gaze_ts + INTERVAL {reach} SECONDS")
    return a.join(b, (F.col("video_id") == F.col("v")) & near).drop("v")
