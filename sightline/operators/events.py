"""Five detectors of social events on frame rows (see features.py), and their union.

Each returns video_id, event_id, event_type, start_time, end_time, start_frame, end_frame, confidence, persons and
details. Ids count the events of a video from the detector's base, in the order in which a scan over frames meets them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance, inside
from .features import KEY
from .islands import merge_intervals, sessionize, unlike

DETAILS = "struct<max_velocity:double,mean_velocity:double,duration:double,num_frames:bigint,num_persons:bigint,max_convergence:double,mean_convergence:double,center_x:double,center_y:double,leader_id:bigint,follower_id:bigint,lag_seconds:double,gaze_distance:double>"

#: Kinds of event whose confidence is a mean.
MEANS = ["joint_attention", "attention_capture"]


def _events(df: DataFrame, kind: str, base: int, order: list[str], persons: Column, **details: Column) -> DataFrame:
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy(*order)) - 1 + base
    names = [f.split(":")[0] for f in DETAILS[7:-1].split(",")]
    held = F.struct(*(details.get(n, F.lit(None)).alias(n) for n in names)).cast(DETAILS)
    return df.select(*KEY, number.cast("long").alias("event_id"), F.lit(kind).alias("event_type"), "start_time", "end_time", "start_frame", "end_frame", "confidence", persons.cast("array<bigint>").alias("persons"), held.alias("details"))


def _span() -> list[Column]:
    return [F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), F.count("*").alias("num_frames")]


def sudden_gaze_shifts(rows: DataFrame, velocity: float = 0.7, shortest: float = 0.5, longest: float = 1.5) -> DataFrame:
    """Runs of fast frames of a present person; gaps under 0.6 s."""
    fast = rows.where(F.col("face") & (F.col("frame_velocity") > velocity))
    fast = fast.withColumn("met", F.min(F.struct("pos", "person_id")).over(Window.partitionBy(*KEY, "person_id")))
    runs = sessionize(fast, [*KEY, "person_id"], ["pos"], "ts", 0.6).groupBy(*KEY, "person_id", "met", "island").agg(*_span(), F.max("frame_velocity").alias("v"))
    length = F.col("end_time") - F.col("start_time")
    runs = runs.where(length.between(shortest, longest)).withColumn("confidence", F.least(F.lit(1.0), F.col("v") / (velocity * 2)))
    return _events(runs, "sudden_gaze_shift", 0, ["met", "start_time"], F.array("person_id"), max_velocity=F.col("v"), duration=length, num_frames=F.col("num_frames"))


def joint_attention(rows: DataFrame, frames: DataFrame, convergence: float = 0.6, least: int = 2, shortest: float = 0.5, near: float = 0.2) -> DataFrame:
    """Runs of converging frames with like persons; those of the first frame who look near the centre of the peak frame."""
    high = frames.where((F.col("convergence") >= convergence) & (F.col("num_faces") >= least))
    # frames of equal convergence differ in its last bits by the order in which it was summed up, so the earlier one counts within 1e-12 a frame
    runs = sessionize(high, KEY, ["pos"], "ts", 0.6, unlike(KEY, ["pos"], "present")).groupBy(*KEY, "island").agg(
        *_span(), F.min("pos").alias("pos"), F.avg("convergence").alias("confidence"), F.max("convergence").alias("top"), F.max_by(F.struct("center_x", "center_y"), F.col("convergence") * 1e6 - F.col("pos") * 1e-6).alias("center")
    )
    runs = runs.where(F.col("end_time") - F.col("start_time") >= shortest)
    looks = rows.where(F.col("face") & F.col("x").isNotNull()).select(*KEY, "pos", "person_id", "x", "y")
    close = distance(F.col("x"), F.col("y"), F.col("center.center_x"), F.col("center.center_y")) < near
    found = runs.join(looks, [*KEY, "pos"]).where(close).groupBy(*KEY, "island", "start_time", "end_time", "start_frame", "end_frame", "confidence", "top", "center").agg(F.array_sort(F.collect_set("person_id")).alias("who"))
    found = found.where(F.size("who") >= least)
    return _events(found, "joint_attention", 1000, ["start_time"], F.col("who"), max_convergence=F.col("top"), mean_convergence=F.col("confidence"), duration=F.col("end_time") - F.col("start_time"), center_x=F.col("center.center_x"), center_y=F.col("center.center_y"), num_persons=F.size("who"))


def gaze_following(rows: DataFrame, near: float = 0.03, lag: tuple[float, float] = (1.0, 2.0), least: float = 0.9) -> DataFrame:
    """One person looks where another, met before, looked one to two seconds ago. Joined by whole seconds, so a row meets three buckets."""
    good = rows.where(F.col("x").isNotNull() & (F.col("conf") >= 0.5)).withColumn("met", F.min(F.struct("pos", "person_id")).over(Window.partitionBy(*KEY, "person_id")))
    a = good.select(*KEY, F.col("person_id").alias("a"), F.col("met").alias("met_a"), F.col("ts").alias("ta"), F.col("frame_idx").alias("fa"), F.col("x").alias("xa"), F.col("y").alias("ya"), F.explode(F.transform(F.sequence(F.floor(F.col("ts") + lag[0]), F.floor(F.col("ts") + lag[1])), lambda s: s)).alias("second"))
    b = good.select(*KEY, F.col("person_id").alias("b"), F.col("met").alias("met_b"), F.col("ts").alias("tb"), F.col("frame_idx").alias("fb"), F.col("x").alias("xb"), F.col("y").alias("yb"), F.floor("ts").alias("second"))
    d = distance(F.col("xa"), F.col("ya"), F.col("xb"), F.col("yb"))
    pairs = a.join(b, [*KEY, "second"]).where((F.col("met_a") < F.col("met_b")) & (F.col("tb") - F.col("ta")).between(*lag) & (d < near)).withColumns({"d": d, "c": 1.0 - d / near}).where(F.col("c") >= least)
    merged = merge_intervals(pairs, [*KEY, "a", "b"], ["tb"], "ta", "tb", 1.0)
    best = F.max_by(F.struct((F.col("tb") - F.col("ta")).alias("lag"), "d", "c"), F.struct("c", -F.col("ta"), -F.col("tb")))
    runs = merged.groupBy(*KEY, "a", "b", "met_a", "met_b", "island").agg(F.min("ta").alias("start_time"), F.max("tb").alias("end_time"), F.min("fa").alias("start_frame"), F.max("fb").alias("end_frame"), best.alias("best")).withColumn("confidence", F.col("best.c"))
    return _events(runs, "gaze_following", 2000, ["met_a", "met_b", "start_time"], F.array("a", "b"), leader_id=F.col("a"), follower_id=F.col("b"), lag_seconds=F.col("best.lag"), gaze_distance=F.col("best.d"))


def attention_capture(rows: DataFrame, velocity: float = 0.4, least: int = 3, gap: float = 0.5) -> DataFrame:
    """Frames in which three present persons or more look elsewhere at once; the mean is over the greatest velocity of every person in the run."""
    own = F.struct("person_id", F.col("frame_velocity").alias("v"))
    frames = rows.groupBy(*KEY, "pos").agg(F.min("ts").alias("ts"), F.min("frame_idx").alias("frame_idx"), F.array_sort(F.collect_set(F.when(F.col("face"), F.col("person_id")))).alias("present"), F.array_sort(F.collect_set(F.when(F.col("face") & (F.col("frame_velocity") > velocity), F.col("person_id")))).alias("fast"), F.collect_list(own).alias("all"))
    runs = sessionize(frames.where(F.size("fast") >= least), KEY, ["pos"], "ts", gap, unlike(KEY, ["pos"], "present"))
    most = runs.select(*KEY, "island", F.inline("all")).groupBy(*KEY, "island", "person_id").agg(F.max("v").alias("v")).groupBy(*KEY, "island").agg(F.avg("v").alias("mean_v"))
    found = runs.groupBy(*KEY, "island").agg(*_span(), F.min_by("fast", "pos").alias("who")).join(most, [*KEY, "island"]).withColumn("confidence", F.least(F.lit(1.0), F.col("mean_v") / velocity))
    return _events(found, "attention_capture", 3000, ["start_time"], F.col("who"), num_persons=F.size("who"), mean_velocity=F.col("mean_v"))


def mutual_gaze(rows: DataFrame, least: float = 0.5, shortest: float = 1.0, margin: float = 0.02) -> DataFrame:
    """Two persons, gaze measured, each looking into the other's face box; gaps under 1.5 s."""
    good = rows.where(F.col("face") & (F.col("method") == "measured") & (F.col("conf") >= least)).select(*KEY, "pos", "ts", "frame_idx", "person_id", "x", "y", F.array("fx1", "fy1", "fx2", "fy2").alias("box"))
    b = good.select(*KEY, "pos", F.col("person_id").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"), F.col("box").alias("box_b"))
    box = lambda c: [F.col(c)[k] for k in range(4)]
    seen = good.withColumnRenamed("person_id", "a").join(b, [*KEY, "pos"]).where((F.col("a") < F.col("b")) & inside(F.col("x"), F.col("y"), box("box_b"), margin) & inside(F.col("xb"), F.col("yb"), box("box"), margin))
    seen = seen.withColumn("met", F.min(F.struct("pos", "a", "b")).over(Window.partitionBy(*KEY, "a", "b")))
    runs = sessionize(seen, [*KEY, "a", "b"], ["pos"], "ts", 1.5).groupBy(*KEY, "a", "b", "met", "island").agg(*_span())
    length = F.col("end_time") - F.col("start_time")
    runs = runs.where(length >= shortest).withColumn("confidence", F.least(F.lit(1.0), 0.5 + 0.1 * F.col("num_frames")))
    return _events(runs, "mutual_gaze", 4000, ["met", "start_time"], F.array("a", "b"), duration=length, num_frames=F.col("num_frames"))


def all_events(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """All five kinds; by start time, then event id, within a video: pos."""
    each = [sudden_gaze_shifts(rows), joint_attention(rows, frames), gaze_following(rows), attention_capture(rows), mutual_gaze(rows)]
    w = Window.partitionBy(*KEY).orderBy("start_time", "event_id")
    return reduce(DataFrame.unionByName, each).withColumn("place", F.row_number().over(w) - 1)


def candidates(events: DataFrame, least: float = 0.75, n: int = 15) -> DataFrame:
    """The n most confident events of each video, from `least` confidence on, with their rank. Confidences that are means and
    differ in their last bits, by the order in which they were summed up, are equal."""
    sure = F.when(F.col("event_type").isin(MEANS), F.round("confidence", 12)).otherwise(F.col("confidence"))
    w = Window.partitionBy(*KEY).orderBy(sure.desc(), "start_time", "event_id")
    return events.where(F.col("confidence") >= least).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)
