"""Counts by dataset, kind and threshold; person counts; segments of labelled frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import KEY

TYPES = ["sudden_gaze_shift", "joint_attention", "gaze_following", "attention_capture", "mutual_gaze"]
THRESHOLDS = [0.0, 0.6, 0.7, 0.8, 0.9]


def with_dataset(events: DataFrame, datasets: int = 7) -> DataFrame:
    """A dataset of each video: its number modulo the number of datasets."""
    return events.withColumn("dataset", F.concat(F.lit("d"), (F.substring("video_id", 2, 10).cast("long") % datasets).cast("string")))


def cells(rows: DataFrame, dims: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows summed up for each video in every cell of a cube over dims (null: all): a row for each video and cell it is in.

    Videos are counted exactly by their rows here, in place of sets of videos in each cell. Rows are counted by video and dims
    first, so only these small counts are moved to their video and spread over its cells."""
    small = rows.groupBy(*KEY, *dims).agg(*(c.alias(k) for k, c in sums.items())).repartition(*KEY)
    sets = [[*KEY, *(d for k, d in enumerate(dims) if n >> k & 1)] for n in range(1 << len(dims))]
    return small.groupingSets(sets, *KEY, *dims).agg(*(F.sum(k).alias(k) for k in sums))


def threshold_cube(events: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """Events and videos at each least confidence, by dataset and kind with all totals."""
    each = cells(events, ["dataset", "event_type"], {f"n{k}": F.count_if(F.col("confidence") >= t) for k, t in enumerate(thresholds)})
    at = F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"n{k}").alias("events"), (F.col(f"n{k}") > 0).cast("long").alias("videos")) for k, t in enumerate(thresholds)))
    rows = each.select("dataset", "event_type", F.inline(at)).where("events > 0")
    return rows.groupBy("threshold", "dataset", "event_type").agg(F.sum("events").alias("events"), F.sum("videos").alias("videos"))


def dataset_statistics(events: DataFrame) -> DataFrame:
    """Videos and events of each kind by dataset, and in all (dataset null)."""
    each = cells(events, ["dataset"], {t: F.count_if(F.col("event_type") == t) for t in TYPES})
    return each.groupBy("dataset").agg(F.count("*").alias("videos"), *(F.sum(t).alias(t) for t in TYPES))


def persons_of_videos(gaze: DataFrame, least_pct: float | None = None) -> DataFrame:
    """video_id, persons: tracked persons, or only those with a face in at least so many percent of their rows."""
    face = 100.0 * F.count_if(F.coalesce("face_detected", F.lit(False))) / F.count("*")
    each = gaze.groupBy("video_id", "person_id").agg(face.alias("pct"))
    kept = F.lit(True) if least_pct is None else F.col("pct") >= least_pct
    return each.groupBy("video_id").agg(F.count_if(kept).alias("persons"))


def person_counts(gaze: DataFrame) -> DataFrame:
    """Videos by number of persons, and the upper median of the number over all videos.

    The median is found on the table of counts, which has a row for each number of persons."""
    counts = gaze.groupBy("video_id").agg(F.countDistinct("person_id").alias("persons")).groupBy("persons").agg(F.count("*").alias("videos"))
    rows = F.array_sort(F.collect_list(F.struct("persons", "videos")))
    half = counts.agg(rows.alias("t"), F.sum("videos").alias("n")).select(F.expr("aggregate(t, named_struct('s', 0L, 'm', CAST(NULL AS bigint)), (a, x) -> named_struct('s', a.s + x.videos, 'm', coalesce(a.m, CASE WHEN a.s + x.videos > n div 2 THEN x.persons END)), a -> a.m)").alias("upper_median"))
    return counts.crossJoin(F.broadcast(half))  # one row


def label_segments(rows: DataFrame, gap: int = 5, least: int = 2) -> DataFrame:
    """Runs of labelled frames of a kind: broken by a labelled frame of the video without that kind, or a gap of more than
    `gap` frames; of `least` frames or more. rows: video, frame, kind; a frame may have several kinds, rows may repeat."""
    frames = rows.groupBy("video", "frame").agg(F.collect_set("kind").alias("kinds"))
    place = F.row_number().over(Window.partitionBy("video").orderBy("frame"))
    each = frames.withColumn("place", place).select("video", "frame", "place", F.explode("kinds").alias("kind"))
    w = Window.partitionBy("video", "kind").orderBy("frame")
    new = F.lag("frame").over(w).isNull() | (F.col("place") - F.lag("place").over(w) > 1) | (F.col("frame") - F.lag("frame").over(w) > gap)
    runs = each.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("video", "kind", "island").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("frames")).where(F.col("frames") >= least).drop("island")


def event_statistics(events: DataFrame) -> DataFrame:
    """Counts and percent of each kind by dataset and in all (dataset null), with the mean, median, least and most events of a video."""
    both = events.withColumn("dataset", F.explode(F.array(F.col("dataset"), F.lit(None))))
    videos = both.groupBy("dataset", "video_id").agg(F.count("*").alias("n")).groupBy("dataset").agg(F.avg("n").alias("mean_events"), F.median("n").alias("median_events"), F.min("n").alias("least_events"), F.max("n").alias("most_events"))
    kinds = both.groupBy("dataset", "event_type").agg(F.count("*").alias("events"))
    kinds = kinds.withColumn("percent", 100.0 * F.col("events") / F.sum("events").over(Window.partitionBy("dataset")))
    return kinds.join(videos, kinds.dataset.eqNullSafe(videos.dataset)).drop(videos.dataset)


def dataset_table(videos: DataFrame, events: DataFrame) -> DataFrame:
    """By dataset and in all (dataset null): videos, mean seconds, hours, events of each kind, events of a video, percent of all events.
    videos: dataset, video_id, seconds."""
    v = videos.rollup("dataset").agg(F.count("*").alias("videos"), F.avg("seconds").alias("mean_seconds"), (F.sum("seconds") / 3600).alias("hours"))
    e = events.rollup(F.col("dataset").alias("d")).agg(F.count("*").alias("events"), *(F.count_if(F.col("event_type") == t).alias(t) for t in TYPES))
    out = v.join(e, F.col("dataset").eqNullSafe(F.col("d")), "left").drop("d").na.fill(0, ["events", *TYPES])
    whole = F.max(F.when(F.col("dataset").isNull(), F.col("events"))).over(Window.partitionBy(F.lit(1)))  # a row a dataset
    return out.withColumns({"events_of_video": F.col("events") / F.col("videos"), "percent": F.when(whole > 0, 100.0 * F.col("events") / whole).otherwise(0.0)})


def threshold_averages(events: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """At each least confidence, by dataset and in all: events, videos that have any, and their average."""
    whole = threshold_cube(events, thresholds).where("event_type IS NULL").drop("event_type")
    return whole.withColumn("average", F.col("events") / F.col("videos"))


def person_statistics(videos: DataFrame) -> DataFrame:
    """Least, most, mean and upper median of persons over all videos. videos: persons."""
    counts = videos.groupBy("persons").agg(F.count("*").alias("n"))
    w = Window.orderBy("persons").rowsBetween(Window.unboundedPreceding, 0)  # a row for each number of persons
    ranked = counts.withColumns({"upto": F.sum("n").over(w), "all": F.sum("n").over(Window.partitionBy(F.lit(1)))})
    return ranked.agg(F.min("persons").alias("least"), F.max("persons").alias("most"), (F.sum(F.col("persons") * F.col("n")) / F.sum("n")).alias("mean"), F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("persons"))).alias("upper_median"))


def route_by_persons(videos: DataFrame, most: int = 6) -> DataFrame:
    """videos (video_id, persons) with keep: whether they have no more than `most` persons."""
    return videos.withColumn("keep", F.col("persons") <= most)


def largest(videos: DataFrame, most: int = 6, n: int = 20) -> DataFrame:
    """The n videos with most persons of those over the limit."""
    return videos.where(F.col("persons") > most).orderBy(F.col("persons").desc(), "video_id").limit(n)


def duration_statistics(videos: DataFrame, fps: float = 2.0) -> DataFrame:
    """By dataset and in all (dataset null): videos, seconds (frames by fps), hours, mean. videos: dataset, frames."""
    seconds = F.sum("frames") / fps
    return videos.rollup("dataset").agg(F.count("*").alias("videos"), seconds.alias("seconds"), (seconds / 3600).alias("hours"), (seconds / F.count("*")).alias("mean_seconds"))


def outcomes(jobs: DataFrame, states: list[str]) -> DataFrame:
    """Jobs of each state by dataset and in all (dataset null). jobs: dataset, state."""
    return jobs.rollup("dataset").agg(*(F.count_if(F.col("state") == s).alias(s) for s in states))


def sample_videos(videos: DataFrame, n: int | None = None, ratio: float | None = None, seed: int = 42) -> DataFrame:
    """n videos, or that share of them (one at least), by hashes of their ids: the same ones each time."""
    if n is None:
        n = max(1, int(videos.count() * ratio))
    return videos.orderBy(F.xxhash64("video_id", F.lit(seed)), "video_id").limit(n)


def first_frames(rows: DataFrame, n: int) -> DataFrame:
    """The rows of the first n frames of each video. rows: video_id, frame_idx."""
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    return rows.withColumn("_r", F.dense_rank().over(w)).where(F.col("_r") <= n).drop("_r")
