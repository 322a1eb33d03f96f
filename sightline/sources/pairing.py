"""Files of different stages that belong together, by their names; files are listed, not read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, path: str, ending: str = "*") -> DataFrame:
    """path, modified, bytes of the files under a folder, empty ones left out. Their content is a column that isn't asked for, so it isn't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", ending).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def file_name(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*/", "")


def first_named(wanted: DataFrame, files: DataFrame, names: Column, found: str) -> DataFrame:
    """wanted with the column found: the path of the file whose name comes first in names (an array, for each row), null if none
    of them is there. Of files of one name the least path. wanted: path, one row each."""
    each = wanted.select("path", F.posexplode(F.array_distinct(names)).alias("_place", "_name"))
    held = files.groupBy(file_name(F.col("path")).alias("_name")).agg(F.min("path").alias("_path"))
    best = each.join(held, "_name").groupBy("path").agg(F.min_by("_path", "_place").alias(found))
    return wanted.join(best, "path", "left")


#: Endings by which the inputs of a merge are known, and what a rendered video's events may be called.
GAZE_EVENTS, GESTURES = "_sam3rf_gaze_events.json", "_gestures_v2.json"
RENDERED, RENDERED_LONG = "_viz.mp4", "_sam3rf_viz.mp4"
EVENT_NAMES = ["_events.json", "_gaze_events.json", "_sam3rf_gaze_events.json"]
GESTURE_NAMES = ["_gestures.json", "_gestures_v2.json", "_sam3rf_viz_gestures_v2.json"]


def merge_inputs(gaze: DataFrame, gestures: DataFrame) -> DataFrame:
    """video_id, gaze_path, gesture_path of all videos that have either. gaze and gestures: listings with path; files of other
    endings are left out, of several files of a video the greatest path counts."""
    sides = [("gaze_path", gaze, GAZE_EVENTS), ("gesture_path", gestures, GESTURES)]
    rows = [d.where(F.endswith("path", F.lit(e))).select(F.expr(f"left({F_NAME}, length({F_NAME}) - {len(e)})").alias("video_id"), F.lit(k).alias("_k"), "path") for k, d, e in sides]
    return reduce(DataFrame.union, rows).groupBy("video_id").agg(*(F.max(F.when(F.col("_k") == k, F.col("path"))).alias(k) for k, *_ in sides))


F_NAME = "regexp_replace(path, '^.*/', '')"


def paired_files(rendered: DataFrame, events: DataFrame, gestures: DataFrame | None = None) -> DataFrame:
    """path, events_path and gestures_path of rendered videos; each may have one of several names, in a fixed order."""
    videos = rendered.where(F.endswith("path", F.lit(RENDERED))).select("path").distinct()
    name = file_name(F.col("path"))
    cut = lambda ending: F.expr(f"left({F_NAME}, length({F_NAME}) - {len(ending)})")
    out = first_named(videos, events, F.array(*(F.concat(cut(RENDERED), F.lit(e)) for e in EVENT_NAMES)), "events_path")
    if gestures is None:
        return out
    base = F.when(F.endswith(name, F.lit(RENDERED_LONG)), cut(RENDERED_LONG)).otherwise(cut(RENDERED))
    names = F.array(*(F.concat(base, F.lit(e)) for e in GESTURE_NAMES), F.concat(cut(".mp4"), F.lit("_gestures_v2.json")))
    return out.join(first_named(videos, gestures, names, "gestures_path"), "path")
