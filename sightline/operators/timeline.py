"""Merged timelines of gaze events and gestures, pairs across the two, and choices among events.

A timeline row has video_id, source ('gaze' or 'gesture'), item (the event's or gesture's key), kind, start_time,
end_time, confidence, persons (sorted array). Self-joins within a video are banded by time, so a busy video is split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import save
from .features import KEY
from .islands import merge_intervals

#: Seconds of a band.
BAND = 10


def filter_gestures(gestures: DataFrame, least: float = 0.85, longest: float = 120.0) -> DataFrame:
    """Confident gestures, start snapped down and end up to half seconds, none beyond the video's end."""
    out = gestures.where(F.coalesce("confidence", F.lit(0.0)) >= least)
    return out.withColumns({"start_time": F.floor(F.col("start_time") * 2) / 2.0, "end_time": F.ceil(F.col("end_time") * 2) / 2.0}).where(F.col("end_time") <= longest)


def merge(gaze_events: DataFrame, gestures: DataFrame, gaze_least: float = 0.9) -> DataFrame:
    """One timeline in order of start, end, gaze before gestures; place counts from 0."""
    a = gaze_events.where(F.coalesce("confidence", F.lit(0.0)) >= gaze_least).select(*KEY, F.lit("gaze").alias("source"), F.col("event_id").alias("item"), F.col("event_type").alias("kind"), "start_time", "end_time", "confidence", F.array_sort(F.array("person_a", "person_b")).alias("persons"))
    b = gestures.select(*KEY, F.lit("gesture").alias("source"), F.col("gesture_key").alias("item"), F.col("gesture_type").alias("kind"), "start_time", "end_time", "confidence", F.array_compact(F.array("initiator_id", "target_person_id")).alias("persons"))
    w = Window.partitionBy(*KEY).orderBy("start_time", "end_time", "source", "item")
    return a.unionByName(b).withColumn("place", F.row_number().over(w) - 1)


def banded(a: DataFrame, b: DataFrame, reach: float, width: float = BAND) -> DataFrame:
    """Pairs of a (columns of a_) and b (b_) of a video whose intervals come within reach: each pair in the first band it shares."""
    band = lambda c: F.floor(c / width)
    x = a.select(*KEY, *(F.col(c).alias(f"a_{c}") for c in a.columns if c not in KEY)).withColumn("_band", F.explode(F.sequence(band(F.col("a_start_time") - reach), band(F.col("a_end_time") + reach))))
    y = b.select(*KEY, *(F.col(c).alias(f"b_{c}") for c in b.columns if c not in KEY)).withColumn("_band", F.explode(F.sequence(band(F.col("b_start_time")), band(F.col("b_end_time")))))
    near = (F.col("b_start_time") <= F.col("a_end_time") + reach) & (F.col("b_end_time") >= F.col("a_start_time") - reach)
    first = F.col("_band") == band(F.greatest(F.col("a_start_time") - reach, "b_start_time"))
    return x.join(y, [*KEY, "_band"]).where(near & first).drop("_band")


def span_pairs(timeline: DataFrame, proximity: float = 3.0) -> DataFrame:
    """Pairs of spans (start and end) of gaze events and gestures that overlap, or are at most proximity seconds apart: a_ and b_
    first and last (places), relation and seconds. Rows of one source and span are neighbours in a timeline, so they are a
    range of places, and are paired once, however many they are."""
    spans = timeline.groupBy(*KEY, "source", "start_time", "end_time").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    both = banded(spans.where("source = 'gaze'"), spans.where("source = 'gesture'"), proximity)
    apart = F.greatest("a_start_time", "b_start_time") - F.least("a_end_time", "b_end_time")
    over = (F.col("a_start_time") < F.col("b_end_time")) & (F.col("b_start_time") < F.col("a_end_time"))
    both = both.where(over | (apart <= proximity))
    return both.select(*KEY, *(f"{s}_{c}" for s in "ab" for c in ("first", "last")), F.when(over, "overlap").otherwise("adjacent").alias("relation"), F.round(F.when(over, -apart).otherwise(apart), 2).alias("seconds"))


def cross_modal_pairs(timeline: DataFrame, proximity: float = 3.0) -> DataFrame:
    """Gaze events and gestures that overlap (strictly), or are at most proximity seconds apart. places in the timeline have no gaps."""
    each = span_pairs(timeline, proximity).withColumn("gaze_place", F.explode(F.sequence("a_first", "a_last")))
    return each.select(*KEY, "gaze_place", F.explode(F.sequence("b_first", "b_last")).alias("gesture_place"), "relation", "seconds")


def pair_counts(timeline: DataFrame, proximity: float = 3.0) -> DataFrame:
    """video_id, pairs: how many cross_modal_pairs() a video has, if any, without making them."""
    n = lambda s: F.col(f"{s}_last") - F.col(f"{s}_first") + F.lit(1).cast("long")
    return span_pairs(timeline, proximity).groupBy(*KEY).agg(F.sum(n("a") * n("b")).alias("pairs"))


def paired_places(timeline: DataFrame, proximity: float = 3.0) -> DataFrame:
    """video_id, place of the rows that are in any of cross_modal_pairs(), once each, without making them."""
    spans = span_pairs(timeline, proximity)
    sides = [spans.select(*KEY, F.col(f"{s}_first").alias("first"), F.col(f"{s}_last").alias("last")) for s in "ab"]
    return sides[0].unionByName(sides[1]).distinct().select(*KEY, F.explode(F.sequence("first", "last")).alias("place"))


def temporal_relations(events: DataFrame, reach: float = 3.0) -> DataFrame:
    """For events in order of start and end: later ones that overlap, or start within reach seconds after the end. events: item, start_time, end_time.

    Events of one span are paired with those of another as wholes, and then listed."""
    spans = events.select(*KEY, "item", "start_time", "end_time").groupBy(*KEY, "start_time", "end_time").agg(F.array_sort(F.collect_list("item")).alias("items"))
    later = (F.col("a_start_time") < F.col("b_start_time")) | ((F.col("a_start_time") == F.col("b_start_time")) & (F.col("a_end_time") <= F.col("b_end_time")))
    pairs = banded(spans, spans, reach).where(later & (F.col("b_start_time") - F.col("a_end_time") <= reach))
    over = F.col("a_end_time") > F.col("b_start_time")
    same = (F.col("a_start_time") == F.col("b_start_time")) & (F.col("a_end_time") == F.col("b_end_time"))
    seconds = F.when(over, F.least("a_end_time", "b_end_time") - F.col("b_start_time")).otherwise(F.col("b_start_time") - F.col("a_end_time"))
    told = pairs.select(*KEY, "a_items", "b_items", same.alias("_same"), F.when(over, "overlaps").otherwise("immediately_follows").alias("relation"), F.round(seconds, 2).alias("seconds"))
    each = told.select("*", F.posexplode("a_items").alias("_k", "item_a"))
    # of equal spans, each with those after it
    rest = F.when(F.col("_same"), F.slice("b_items", F.col("_k") + 2, F.size("b_items"))).otherwise(F.col("b_items"))
    return each.select(*KEY, "item_a", F.explode(rest).alias("item_b"), "relation", "seconds")


def top_in_time(events: DataFrame, n: int = 50) -> DataFrame:
    """The n most confident of each video, numbered in time order again."""
    best = Window.partitionBy(*KEY).orderBy(F.col("confidence").desc(), "start_time", "item")
    time = Window.partitionBy(*KEY).orderBy("start_time", "item")
    return events.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= n).drop("_r").withColumn("rank", F.row_number().over(time))


def fallback_sample(gestures: DataFrame, n: int = 3) -> DataFrame:
    """At most n gestures of a video: the best of each kind, then the best of the rest."""
    order = [F.col("confidence").desc(), F.col("start_time"), F.col("gesture_key")]
    rows = gestures.withColumn("_best", F.row_number().over(Window.partitionBy(*KEY, "gesture_type").orderBy(*order)) == 1)
    w = Window.partitionBy(*KEY).orderBy(F.col("_best").desc(), *order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("_best")


def drop_doubles(timeline: DataFrame, protected: DataFrame) -> DataFrame:
    """Drops the less confident of two events of a source, kind and persons that overlap, in order; never a protected one.

    Each decision depends on those before, but only among events whose intervals hang together: such runs are cut out by a
    window, and each is folded by itself. An event that meets a more confident one goes, and what it would have met after
    that stays; until then, it drops the others that it meets. The fold holds those that stay so far and haven't ended yet.
    Of two that meet one isn't protected, so protected events that overlap none that isn't stay out of it."""
    rows = timeline.join(protected.select(*KEY, "place").distinct().withColumn("protected", F.lit(True)), [*KEY, "place"], "left").withColumn("protected", F.coalesce("protected", F.lit(False)))
    names = rows.columns
    alike = [*KEY, "source", "kind", "_who"]
    w = Window.partitionBy(*alike).orderBy("start_time", "end_time", "place")
    loose = lambda c: F.when(~F.col("protected"), F.col(c))
    rows = rows.withColumn("_who", F.array_sort(F.array_distinct("persons")))
    rows = rows.withColumns({"_before": F.max(loose("end_time")).over(w), "_after": F.min(loose("start_time")).over(w.rowsBetween(0, Window.unboundedFollowing))})
    safe = F.col("protected") & ~F.coalesce(F.col("_before") > F.col("start_time"), F.lit(False)) & ~F.coalesce(F.col("_after") < F.col("end_time"), F.lit(False))
    rows = save(rows.withColumn("_safe", safe).drop("_before", "_after"), "doubles")  # read twice
    loose_rows = merge_intervals(rows.where("NOT _safe"), alike, ["end_time", "place"], slack=0.0, name="_run")
    runs = loose_rows.groupBy(*alike, "_run").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct(*names).alias("e")))), lambda x: x["e"]).alias("_e"))

    def meet(state: Column, b: Column) -> Column:
        overlaps = lambda a: (a["start_time"] < b["end_time"]) & (b["start_time"] < a["end_time"])
        at = F.array_position(F.transform(state["open"], lambda a: overlaps(a) & (a["confidence"] >= b["confidence"]) & ~b["protected"]), True)  # the first that drops b; 0: none
        beaten = lambda a, k: overlaps(a) & (a["confidence"] < b["confidence"]) & ~a["protected"] & ((at == 0) | (k < at - 1))
        left = F.filter(state["open"], lambda a, k: ~beaten(a, k))
        own = F.when(at == 0, F.array(b)).otherwise(F.slice(F.array(b), 1, 0))
        still = F.concat(F.filter(left, lambda a: a["end_time"] > b["start_time"]), own)
        return F.struct(still.alias("open"), F.concat(state["kept"], F.filter(left, lambda a: a["end_time"] <= b["start_time"])).alias("kept"))

    none = F.slice("_e", 1, 0)
    kept = F.aggregate("_e", F.struct(none.alias("open"), none.alias("kept")), meet, lambda state: F.concat(state["kept"], state["open"]))
    folded = runs.select(F.inline(F.when(F.size("_e") == 1, F.col("_e")).otherwise(kept))).select(*names)
    return rows.where("_safe").select(*names).unionByName(folded)


def cap(rows: DataFrame, n: int = 25) -> DataFrame:
    """At most n rows of a video (more if more must stay): the protected, the first of each source and kind, then the most confident. rows: with protected."""
    first = F.row_number().over(Window.partitionBy(*KEY, "source", "kind").orderBy("place")) == 1
    rows = rows.withColumn("_must", F.col("protected") | first)
    w = Window.partitionBy(*KEY).orderBy("_must", F.col("confidence").desc(), "place")
    whole = Window.partitionBy(*KEY)
    rows = rows.withColumns({"_n": F.count("*").over(whole), "_musts": F.count_if("_must").over(whole), "_rank": F.row_number().over(w)})
    return rows.where((F.col("_n") <= n) | F.col("_must") | (F.col("_rank") <= n - F.col("_musts"))).drop("_must", "_n", "_musts", "_rank")


def filter_timeline(timeline: DataFrame, proximity: float = 3.0, n: int = 25) -> DataFrame:
    """Protects events in cross-modal pairs, drops doubles, caps. cross_modal_pairs() of renumbered() rows are the graph's pairs."""
    return cap(drop_doubles(timeline, paired_places(timeline, proximity)), n)


def renumbered(rows: DataFrame) -> DataFrame:
    """Rows that were left of a timeline, with places that count from 0 again."""
    w = Window.partitionBy(*KEY).orderBy("place")
    return rows.withColumn("place", F.row_number().over(w) - 1)


def summary(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each video: gaze_events, gestures, pairs, first start, last end and the length estimated from it."""
    counts = pairs.groupBy(*KEY).agg(F.count("*").alias("pairs"))
    out = rows.groupBy(*KEY).agg(F.count_if(F.col("source") == "gaze").alias("gaze_events"), F.count_if(F.col("source") == "gesture").alias("gestures"), F.min("start_time").alias("first_start"), F.max("end_time").alias("last_end"), (F.max("end_time") + 5).alias("duration"))
    return out.join(counts, KEY, "left").na.fill(0, ["pairs"])


def person_ids(rows: DataFrame) -> DataFrame:
    """The persons of each video's timeline, sorted."""
    return rows.select(*KEY, F.explode("persons").alias("p")).groupBy(*KEY).agg(F.array_sort(F.collect_set("p")).alias("persons"))


def active_at(frames: DataFrame, events: DataFrame) -> DataFrame:
    """Events that are on at a frame's time, both ends included. frames: pos, ts; events: item, start_time, end_time."""
    spans = events.select(*KEY, "item", "start_time", "end_time", F.explode(F.sequence(F.floor(F.col("start_time") / BAND), F.floor(F.col("end_time") / BAND))).alias("_band"))
    return frames.withColumn("_band", F.floor(F.col("ts") / BAND)).join(spans, [*KEY, "_band"]).where(F.col("ts").between(F.col("start_time"), F.col("end_time"))).select(*KEY, "pos", "item")
