"""Predictions against ground truth: one-to-one matching, precision and recall, confusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import frame_iou, overlap_seconds
from ..session import save
from .features import KEY
from .islands import merge_intervals, take_free
from .matching import match
from .timeline import banded


def candidates(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Pairs that share time, touching included. gt: gt_key, gesture_type, start_time, end_time; pred: gesture_key likewise."""
    pairs = banded(pred, gt, 0.0)
    return pairs.withColumn("seconds", overlap_seconds(F.col("a_start_time"), F.col("a_end_time"), F.col("b_start_time"), F.col("b_end_time")))


def in_islands(gt: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """pred with _island: the run of intervals of both sides, which touch or overlap one after the other, that it lies in. keys:
    columns of both sides within which they can match. What is matched in one run has no bearing on another."""
    both = pred.withColumn("_gt", F.lit(False)).unionByName(gt.select(*keys, "start_time", "end_time", F.lit(True).alias("_gt")), allowMissingColumns=True)
    return merge_intervals(both, keys, ["end_time"], slack=0.0, name="_island").where("NOT _gt").drop("_gt")


def greedy_match(gt: DataFrame, pred: DataFrame, listed: bool = False) -> DataFrame:
    """Each prediction in order takes the first free ground truth of its kind that it overlaps: gesture_key, gt_key, seconds.

    Both in order of time, or, listed, in that of their keys (places in their documents)."""
    return match(pred, gt, [*KEY, "gesture_type"], "gesture_key", "gt_key", listed)


def scores(gt: DataFrame, pred: DataFrame, matched: DataFrame) -> DataFrame:
    """Counts, precision, recall, F1 and mean overlap for each kind and in all (kind null)."""
    marks = matched.select("gesture_type", F.lit(0).alias("g"), F.lit(0).alias("p"), F.lit(1).alias("m"), "seconds").unionByName(gt.select("gesture_type", F.lit(1).alias("g"), F.lit(0).alias("p"), F.lit(0).alias("m"), F.lit(0.0).alias("seconds"))).unionByName(pred.select("gesture_type", F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("m"), F.lit(0.0).alias("seconds")))
    out = marks.rollup("gesture_type").agg(F.sum("m").alias("tp"), (F.sum("p") - F.sum("m")).alias("fp"), (F.sum("g") - F.sum("m")).alias("fn"), F.sum("seconds").alias("s"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "mean_overlap": ratio(F.col("s"), F.col("tp"))}).drop("s")
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confusion(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """For each ground truth the prediction of any kind with the longest overlap (the first of equals): gt_type, pred_type, n.

    Missed: pred_type null. A prediction that no ground truth takes is a false alarm: gt_type null."""
    span = ["b_start_time", "b_end_time"]
    # of predictions that start together none overlaps longer than the longest, so those alone are paired, with distinct spans
    longest = pred.groupBy(*KEY, "start_time").agg(F.max("end_time").alias("end_time"))
    pairs = candidates(gt.select(*KEY, "start_time", "end_time").distinct(), longest).where("seconds > 0")
    best = pairs.groupBy(*KEY, *span).agg(F.max("seconds").alias("best")).withColumnsRenamed({c: c[2:] for c in span})
    again = candidates(best, longest).where("seconds = b_best")  # pairs are made twice, so that none is shuffled
    first = again.groupBy(*KEY, *span, F.col("b_best").alias("_best")).agg(F.min("a_start_time").alias("start_time"))
    # the key decides among those that start there and overlap as long
    alike = pred.groupBy(*KEY, "start_time", "end_time", "gesture_type").agg(F.min("gesture_key").alias("gesture_key"))
    tied = alike.join(first, [*KEY, "start_time"]).where(overlap_seconds(F.col("start_time"), F.col("end_time"), F.col("b_start_time"), F.col("b_end_time")) == F.col("_best"))
    each = tied.groupBy(*KEY, *span, "gesture_type").agg(F.min("gesture_key").alias("gesture_key"))
    taken = each.groupBy(*KEY, *span).agg(F.min_by(F.struct(F.col("gesture_type").alias("pred_type"), "gesture_key"), "gesture_key").alias("_t")).select(*KEY, F.col("b_start_time").alias("start_time"), F.col("b_end_time").alias("end_time"), "_t.*")
    taken = save(taken, "taken")
    wanted = gt.groupBy(*KEY, "start_time", "end_time", F.col("gesture_type").alias("gt_type")).agg(F.count("*").alias("n"))
    met = wanted.join(taken, [*KEY, "start_time", "end_time"], "left").select("gt_type", "pred_type", "n")
    alarms = pred.join(taken, [*KEY, "gesture_key"], "left_anti").groupBy(F.col("gesture_type").alias("pred_type")).agg(F.count("*").alias("n"))
    return met.unionByName(alarms, allowMissingColumns=True).groupBy("gt_type", "pred_type").agg(F.sum("n").alias("n"))


def confusion_matrix(cells: DataFrame, kinds: list[str]) -> DataFrame:
    """A row for each kind of ground truth (false alarms: null), a column for each kind predicted, and missed."""
    named = cells.withColumn("pred_type", F.coalesce("pred_type", F.lit("missed")))
    return named.groupBy("gt_type").pivot("pred_type", [*kinds, "missed"]).agg(F.sum("n")).na.fill(0, [*kinds, "missed"])


#: Labels of gaze and the kinds of event that may stand for them.
STANDS_FOR = {"mutual": ["mutual_gaze"], "share": ["joint_attention"], "refer": ["joint_attention", "gaze_following"]}
#: Parts of a segment, in seconds.
PARTS = [0, 40, 80, 120]


def _key_of(c):
    return F.regexp_replace(c, "[ .]", "_")


def match_keys(videos: DataFrame, keys: DataFrame) -> DataFrame:
    """videos (video_id) with gt_video: the key (column gt_video of keys) that is equal, else equal with blanks for
    underscores, else the least of those equal with underscores for blanks and stops; null if there is none."""
    loose = keys.groupBy(_key_of(F.col("gt_video")).alias("_loose")).agg(F.min("gt_video").alias("_third"))
    own = keys.select("gt_video").distinct()
    out = videos.join(own.withColumnRenamed("gt_video", "_first"), F.col("video_id") == F.col("_first"), "left")
    out = out.join(own.withColumnRenamed("gt_video", "_second"), F.translate("video_id", "_", " ") == F.col("_second"), "left")
    out = out.join(loose, _key_of(F.col("video_id")) == F.col("_loose"), "left")
    return out.select(*videos.columns, F.coalesce("_first", "_second", "_third").alias("gt_video"))


def local_times(events: DataFrame, segments: DataFrame) -> DataFrame:
    """events with segment and local_time: of the segment that began last before or at their start; the first, and the
    time as it is, if none did. segments: video_id, segment, offset_seconds."""
    marks = segments.select(*KEY, F.col("offset_seconds").alias("_t"), F.lit(0).alias("_kind"), F.struct("segment", "offset_seconds").alias("_s"))
    rows = events.withColumns({"_t": F.col("start_time").cast("double"), "_kind": F.lit(1), "_s": F.lit(None).cast(marks.schema["_s"].dataType)})
    w = Window.partitionBy(*KEY).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("_s", F.last("_s", ignorenulls=True).over(w)).where("_kind = 1")
    return both.withColumns({"segment": F.coalesce("_s.segment", F.lit(1)), "local_time": F.col("start_time") - F.coalesce("_s.offset_seconds", F.lit(0.0))}).drop("_t", "_kind", "_s")


def part_of(local):
    """The part of a segment that a local time lies in, like `40-80s`; null beyond."""
    out = F.when(F.lit(False), F.lit(""))
    for a, z in zip(PARTS, PARTS[1:]):
        out = out.when((local >= a) & (local < z), f"{a}-{z}s")
    return out


def scores_by_part(gt: DataFrame, pred: DataFrame, listed: bool = False) -> DataFrame:
    """scores() for each part of the segments (column part of both sides), matched within the part."""
    both = lambda d: d.where("part IS NOT NULL").withColumn("gesture_type", F.concat_ws("|", "part", "gesture_type"))
    g, p = both(gt), both(pred)
    out = scores(g, p, greedy_match(g, p, listed)).where("gesture_type IS NOT NULL")
    cut = F.split("gesture_type", "[|]", 2)
    return out.withColumns({"part": cut[0], "gesture_type": cut[1]})


def keep_matched(gestures: DataFrame, gt: DataFrame, n: int = 3, listed: bool = False) -> DataFrame:
    """Gestures that match a ground truth of their kind, in order, one to one; in a video without any, a sample of n.
    choice says which: gt_match or fallback_sample. Both sides on one clock."""
    from .timeline import fallback_sample

    found = greedy_match(gt, gestures, listed).select(*KEY, "gesture_key")
    kept = gestures.join(found, [*KEY, "gesture_key"], "left_semi").withColumn("choice", F.lit("gt_match"))
    rest = gestures.join(found.select(*KEY).distinct(), KEY, "left_anti")
    return kept.unionByName(fallback_sample(rest, n).drop("rank").withColumn("choice", F.lit("fallback_sample")))


def match_gaze(gt: DataFrame, pred: DataFrame, least: float = 0.3) -> DataFrame:
    """Each labelled segment in order takes the free event of a kind that stands for it with the best overlap in frames.

    gt: video_id, gt_no, kind, start_frame, end_frame. pred: video_id, event_id, event_type, start_frame, end_frame.
    Returns video_id, gt_no, kind, event_id, iou. Only pairs over the threshold are looked at one by one, those of one run of
    overlapping segments and events together."""
    stands = F.create_map(*(x for k, es in STANDS_FOR.items() for x in (F.lit(k), F.array(*map(F.lit, es)))))
    # kinds that can want the same event are looked at together
    group = lambda c: F.when(c.isin("mutual", "mutual_gaze"), "mutual").otherwise("other")
    a = gt.where(F.col("kind").isin(list(STANDS_FOR))).select(*KEY, "kind", "gt_no", F.col("start_frame").alias("start_time"), F.col("end_frame").alias("end_time"), group(F.col("kind")).alias("_group"))
    b = pred.select(*KEY, "event_type", "event_id", F.col("start_frame").alias("start_time"), F.col("end_frame").alias("end_time"), group(F.col("event_type")).alias("_group")).where(F.col("event_type").isin([e for es in STANDS_FOR.values() for e in es]))
    pairs = banded(in_islands(a, b, [*KEY, "_group"]), a, 0.0, 300).where(F.array_contains(stands[F.col("b_kind")], F.col("a_event_type")))
    pairs = pairs.select(*KEY, F.col("b_gt_no").alias("gt_no"), F.col("b_kind").alias("kind"), F.col("a_event_id").alias("event_id"), frame_iou(F.col("b_start_time"), F.col("b_end_time"), F.col("a_start_time"), F.col("a_end_time")).alias("iou"), F.col("a__group").alias("_group"), F.col("a__island").alias("_island")).where(F.col("iou") >= least)
    taken = take_free(pairs, [*KEY, "_group", "_island"], [F.col("gt_no"), -F.col("iou"), F.col("event_id")], "gt_no", "event_id")
    return taken.drop("_group", "_island")


def gaze_counts(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """For each video: gt_segments and events that can match, and on which sides it occurs (both, gt, pred)."""
    kinds = [e for es in STANDS_FOR.values() for e in es]
    g = gt.groupBy(*KEY).agg(F.count_if(F.col("kind").isin(list(STANDS_FOR))).alias("gt_segments"))
    p = pred.groupBy(*KEY).agg(F.count_if(F.col("event_type").isin(kinds)).alias("events"))
    out = g.join(p, KEY, "full_outer")
    return out.withColumn("side", F.when(F.col("events").isNull(), "gt").when(F.col("gt_segments").isNull(), "pred").otherwise("both")).na.fill(0, ["gt_segments", "events"])


def gaze_scores(gt: DataFrame, pred: DataFrame, matched: DataFrame) -> DataFrame:
    """Counts, precision, recall, F1 and mean overlap for each video of both sides, and in all (video_id null): summed counts,
    and the mean of the videos' overlaps above 0."""
    found = matched.groupBy(*KEY).agg(F.count("*").alias("matched"), F.avg("iou").alias("mean_iou"))
    each = gaze_counts(gt, pred).where("side = 'both'").drop("side").join(found, KEY, "left").na.fill(0, ["matched", "mean_iou"])
    whole = each.agg(F.lit(None).cast("string").alias("video_id"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("gt_segments", "events", "matched")), F.coalesce(F.avg(F.when(F.col("mean_iou") > 0, F.col("mean_iou"))), F.lit(0.0)).alias("mean_iou"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = each.unionByName(whole).withColumns({"precision": ratio(F.col("matched"), F.col("events")), "recall": ratio(F.col("matched"), F.col("gt_segments"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
