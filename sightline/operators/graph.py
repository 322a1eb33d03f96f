"""Graphs of a video's events: what is told of each event, descriptions that come back, relations and counts; and the merge of
both kinds of events over segments of longer videos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import segment_name
from . import evaluate, timeline
from .features import KEY
from .islands import offsets

#: Details that are told of each kind of gaze event, and what they are called there. Those of the first list are told even if null.
ALWAYS = {"gaze_following": {"leader_id": "leader_id", "follower_id": "follower_id"}}
IF_SET = {
    "gaze_following": {"lag_seconds": "lag_seconds"},
    "mutual_gaze": {"duration": "gaze_duration"},
    "joint_attention": {"num_persons": "num_persons"},
    "attention_capture": {"num_persons": "num_persons"},
}
#: Seconds of a segment whose length isn't known.
LENGTH = 120.0


def at_least(rows: DataFrame, least: float, default: float = 0.0) -> DataFrame:
    """Rows of a confidence of `least` or more; default: what a missing one counts as (0 where timelines are merged, 1 where
    events are evaluated or counted)."""
    return rows.where(F.coalesce("confidence", F.lit(default)) >= least)


def chosen(rows: DataFrame, datasets: list[str] | None = None, videos: list[str] | None = None) -> DataFrame:
    """Rows of these datasets and these videos; None: all. On a table in folders by dataset, other folders aren't read."""
    if datasets is not None:
        rows = rows.where(F.col("dataset").isin(datasets))
    return rows if videos is None else rows.where(F.col("video_id").isin(videos))


def told_details(kind: Column, details: Column, rename: bool = True) -> Column:
    """A map from names to values (variants) of what is told of an event. Numbers that are 0 or null are left out, but for ids.

    details: a struct, of which the fields of any kind may be null."""
    pairs = []
    for k, fields in ALWAYS.items():
        pairs += [F.when(kind == k, F.struct(F.lit(name).alias("key"), F.coalesce(details[f].cast("variant"), F.parse_json(F.lit("null"))).alias("value"))) for f, name in fields.items()]
    for k, fields in IF_SET.items():
        pairs += [F.when((kind == k) & (details[f] != 0), F.struct(F.lit(name if rename else f).alias("key"), details[f].cast("variant").alias("value"))) for f, name in fields.items()]
    return F.map_from_entries(F.array_compact(F.array(*pairs)))


def _object(*entries: tuple[str, Column], more: Column | None = None) -> Column:
    """A variant with these fields and those of a map of variants."""
    own = F.map_from_arrays(F.array(*(F.lit(k) for k, _ in entries)), F.array(*(F.coalesce(c.cast("variant"), F.parse_json(F.lit("null"))) for _, c in entries)))
    return F.to_variant_object(own if more is None else F.map_concat(own, more))


def told_event(place: Column) -> Column:
    """What a prompt is told of a row of rows_with_details(): a variant with the fields that its source and kind have."""
    gaze = _object(
        ("index", place), ("source", F.lit("gaze")), ("event_type", F.col("kind")), ("start_time", F.col("start_time")), ("end_time", F.col("end_time")), ("persons_involved", F.col("persons")),
        more=F.col("told"),
    )
    described = F.when(F.coalesce(F.col("target_description"), F.lit("")) != "", F.map_from_arrays(F.array(F.lit("target_description")), F.array(F.col("target_description").cast("variant")))).otherwise(F.map_from_arrays(F.slice(F.array(F.lit("")), 1, 0), F.slice(F.array(F.lit(None).cast("variant")), 1, 0)))
    gesture = _object(
        ("index", place), ("source", F.lit("gesture")), ("gesture_type", F.col("kind")), ("start_time", F.col("start_time")), ("end_time", F.col("end_time")),
        ("initiator_id", F.col("initiator_id")), ("target_type", F.col("target_type")), ("target_person_id", F.col("target_person_id")), more=described,
    )
    return F.when(F.col("source") == "gaze", gaze).otherwise(gesture)


def payloads(rows: DataFrame) -> DataFrame:
    """video_id, payload: the events of each video in order, as JSON for a prompt. rows: a timeline (see timeline.py) with told (a map
    of variants), initiator_id, target_type, target_person_id, target_description. A timeline has few events (see timeline.cap)."""
    each = rows.withColumn("_t", F.to_json(told_event(F.col("place").cast("long"))))
    return each.groupBy(*KEY).agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "_t"))), lambda x: x["_t"]), ","), F.lit("]")).alias("payload"))


def parse_map(reply: Column) -> Column:
    """A map of texts from a reply: the whole text as JSON, else what lies between its outermost braces, else nothing. Values
    that aren't texts are as they are written."""
    kind = "map<string,string>"
    inner = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.from_json(reply, kind), F.from_json(F.when(inner != "", inner), kind), F.from_json(F.lit("{}"), kind))


def describe(events: DataFrame, replies: DataFrame, id_col: str) -> DataFrame:
    """events with description, from the video's reply (video_id, reply): that of the event's id or place (id_col), null if the reply
    has none or an empty one. The replies are parsed once each and joined by video and id, as a reply may be long."""
    told = replies.select(*KEY, F.explode(parse_map(F.col("reply"))).alias("_id", "description")).where("description <> ''")
    return events.withColumn("_id", F.col(id_col).cast("string")).join(told, [*KEY, "_id"], "left").drop("_id")


def event_graph(events: DataFrame, replies: DataFrame, least: float = 0.9, most: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A graph of each video's gaze events: nodes, edges and a summary.

    events: video_id, item, kind, start_time, end_time, confidence. Nodes: events of a confidence of `least`, in_prompt (whether a
    prompt of `most` events would have them) and their description. Edges: see timeline.temporal_relations. Summary: for each
    video of events: all, kept and described events, edges, first start and last end of those kept (0 if none)."""
    kept = at_least(events, least)
    asked = timeline.top_in_time(kept, most).select(*KEY, "item", F.lit(True).alias("in_prompt"))
    nodes = describe(kept.join(asked, [*KEY, "item"], "left").na.fill(False, ["in_prompt"]), replies, "item")
    edges = timeline.temporal_relations(kept)
    whole = events.groupBy(*KEY).agg(F.count("*").alias("events"))
    own = nodes.groupBy(*KEY).agg(F.count("*").alias("kept"), F.count("description").alias("described"), F.round(F.min("start_time"), 2).alias("first_start"), F.round(F.max("end_time"), 2).alias("last_end"))
    n = edges.groupBy(*KEY).agg(F.count("*").alias("edges"))
    return nodes, edges, whole.join(own, KEY, "left").join(n, KEY, "left").na.fill(0, ["kept", "described", "edges", "first_start", "last_end"])


def cross_graph(rows: DataFrame, replies: DataFrame | None = None, proximity: float = 3.0, most: int = 25) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph of a merged timeline after its filter: nodes (places counted anew, descriptions by place), pairs across both
    kinds of events, and for each video: raw, filtered, gaze, gesture and pairs."""
    nodes = timeline.renumbered(timeline.filter_timeline(rows, proximity, most))
    if replies is not None:
        nodes = describe(nodes, replies, "place")
    pairs = timeline.cross_modal_pairs(nodes, proximity)
    raw = rows.groupBy(*KEY).agg(F.count("*").alias("raw"))
    own = nodes.groupBy(*KEY).agg(F.count("*").alias("filtered"), F.count_if(F.col("source") == "gaze").alias("gaze"), F.count_if(F.col("source") == "gesture").alias("gesture"))
    n = timeline.pair_counts(nodes, proximity)
    return nodes, pairs, raw.join(own, KEY, "left").join(n, KEY, "left").na.fill(0, ["filtered", "gaze", "gesture", "pairs"])


def segment_times(segments: DataFrame, lengths: DataFrame) -> DataFrame:
    """segments (video_id like `name_007`) with video, segment, seconds (of lengths: video_id, seconds; 120 if unknown) and the offset
    of the segment in its video; a name without a number has none of video and segment, and no offset."""
    named = segments.select("video_id").distinct().withColumn("_s", segment_name(F.col("video_id")))
    named = named.select("video_id", F.when(F.col("_s.segment").isNotNull(), F.col("_s.video")).alias("video"), "_s.segment")
    known = lengths.where("seconds > 0").groupBy("video_id").agg(F.max("seconds").cast("double").alias("seconds"))
    rows = named.join(known, "video_id", "left").na.fill(LENGTH, ["seconds"])
    alone = rows.where("video IS NULL").withColumn("offset_seconds", F.lit(0.0))  # one window of all of them would be one task
    return offsets(rows.where("video IS NOT NULL"), ["video"], "segment", F.col("seconds"), "offset_seconds").unionByName(alone)


def on_video_clock(rows: DataFrame, times: DataFrame, back: bool = False) -> DataFrame:
    """rows whose times count from the start of their segment, on the clock of the whole video; back: the other way."""
    by = times.select("video_id", F.col("offset_seconds").alias("_o"))
    shift = lambda c: F.col(c) - F.col("_o") if back else F.col(c) + F.col("_o")
    return rows.join(by, "video_id").withColumns({c: shift(c) for c in ("start_time", "end_time")}).drop("_o")


def merge_job(gaze: DataFrame, gestures: DataFrame, lengths: DataFrame, truth: DataFrame | None = None, least: float = 0.85, samples: int = 3) -> tuple[DataFrame, DataFrame]:
    """One timeline for each segment that has gaze events or gestures, and its counts.

    gaze: video_id, event_id, event_type, times, confidence, person_a, person_b. gestures: video_id, gesture_key (place in the
    document), gesture_type, times, confidence, initiator_id, target_person_id. lengths: video_id, seconds. truth, where
    annotated gestures decide which predicted ones stay: gt_video, gt_key (place), gesture_type, times on the whole video's clock.
    A segment whose video has a truth keeps the gestures that match it, one to one; if none does, a sample.

    Counts: gaze_events, gestures, total; before_truth and choice (gt_match, fallback_sample, no_gestures) where there is a truth."""
    videos = gaze.select("video_id").union(gestures.select("video_id")).distinct()
    times = segment_times(videos, lengths)
    snapped = at_least(gestures, least).withColumns({"start_time": F.floor(F.col("start_time") * 2) / 2.0, "end_time": F.ceil(F.col("end_time") * 2) / 2.0})
    kept = snapped.join(times.select("video_id", "seconds"), "video_id").where("end_time <= seconds").drop("seconds").withColumn("choice", F.lit(None).cast("string"))
    counts = videos
    if truth is not None:
        known = evaluate.match_keys(times.where("video IS NOT NULL").select(F.col("video").alias("video_id")).distinct(), truth.select("gt_video").distinct())
        judged = times.join(known.where("gt_video IS NOT NULL").withColumnRenamed("video_id", "video"), "video").select("video_id", "gt_video", "offset_seconds", "seconds")
        # each segment meets only the truth of its own time
        near = truth.join(judged, "gt_video").where("start_time <= offset_seconds + seconds AND end_time >= offset_seconds").select("video_id", "gt_key", "gesture_type", "start_time", "end_time")
        own = kept.join(judged.select("video_id"), "video_id", "left_semi")
        matched = evaluate.keep_matched(on_video_clock(own, times).drop("choice"), near, samples, listed=True)
        before = own.groupBy("video_id").agg(F.count("*").alias("before_truth"))
        kept = kept.join(judged.select("video_id"), "video_id", "left_anti").unionByName(on_video_clock(matched, times, back=True))
        counts = videos.join(judged.select("video_id", F.lit(True).alias("_judged")), "video_id", "left").join(before, "video_id", "left")
        counts = counts.withColumn("before_truth", F.when(F.col("_judged"), F.coalesce("before_truth", F.lit(0)))).drop("_judged")
    rows = timeline.merge(gaze, kept)
    told = rows.groupBy("video_id").agg(F.count_if(F.col("source") == "gaze").alias("gaze_events"), F.count_if(F.col("source") == "gesture").alias("gestures"), F.count("*").alias("total"))
    counts = counts.join(told, "video_id", "left").na.fill(0, ["gaze_events", "gestures", "total"])
    if truth is not None:
        choice = kept.groupBy("video_id").agg(F.max("choice").alias("choice"))
        counts = counts.join(choice, "video_id", "left").withColumn("choice", F.when(F.col("before_truth").isNotNull(), F.coalesce("choice", F.lit("no_gestures"))))
    return rows, counts


def evaluate_job(gestures: DataFrame, lengths: DataFrame, truth: DataFrame, least: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predicted gestures of segments against the truth of their whole videos: scores by kind and in all, the confusion of kinds,
    and scores by part of the segments. Videos without a truth are left out.

    gestures: video_id (a segment), gesture_key, gesture_type, times on the segment's clock, confidence (missing: 1). truth: as in
    merge_job(). Predictions are taken in order of segment and key, the truth in that of its keys."""
    times = segment_times(gestures.select("video_id"), lengths).where("video IS NOT NULL")
    known = evaluate.match_keys(times.select(F.col("video").alias("video_id")).distinct(), truth.select("gt_video").distinct()).where("gt_video IS NOT NULL")
    rows = on_video_clock(at_least(gestures, least, 1.0), times).join(times.select("video_id", "video", "segment"), "video_id")
    pred = rows.join(known.select(F.col("video_id").alias("video")), "video", "left_semi").select(F.col("video").alias("video_id"), F.struct("segment", "gesture_key").alias("gesture_key"), "gesture_type", "start_time", "end_time")
    gt = truth.join(known, "gt_video").select("video_id", "gt_key", "gesture_type", "start_time", "end_time")
    whole = evaluate.scores(gt, pred, evaluate.greedy_match(gt, pred, listed=True))
    cells = evaluate.confusion(gt, pred)
    marks = times.select(F.col("video").alias("video_id"), "segment", "offset_seconds")
    parted = lambda d: evaluate.local_times(d, marks).withColumn("part", evaluate.part_of(F.col("local_time")))
    return whole, cells, evaluate.scores_by_part(parted(gt), parted(pred), listed=True)
