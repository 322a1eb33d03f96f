"""Queries on timelines, evaluation and reports, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate, features, reports, timeline
from ..sources import adapters
from .gaze import gaze

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def gestures(spark, sf_dir):
    return adapters.rows(spark, sf_dir, adapters.GESTURES)


def gaze_events(spark, sf_dir):
    return adapters.rows(spark, sf_dir, adapters.GAZE_EVENTS)


def gt(spark, sf_dir):
    return adapters.rows(spark, sf_dir, adapters.GT_GESTURES)


def merged(spark, sf_dir):
    return timeline.merge(gaze_events(spark, sf_dir), timeline.filter_gestures(gestures(spark, sf_dir)))


BASE = f"""with s as ({adapters.sql(adapters.GESTURES)}), e as ({adapters.sql(adapters.GAZE_EVENTS)}), gt as ({adapters.sql(adapters.GT_GESTURES)}),
sf as (select * exclude (start_time, end_time), floor(start_time*2)/2e0 start_time, ceil(end_time*2)/2e0 end_time from s where confidence >= 85e-2 and ceil(end_time*2)/2e0 <= 120),
tl as (select *, row_number() over (partition by video_id order by start_time, end_time, source, item) - 1 place from (
  select video_id, 'gaze' source, event_id item, event_type kind, start_time, end_time, confidence, list_sort([person_a, person_b]) persons from e where confidence >= 9e-1 union all
  select video_id, 'gesture', gesture_key, gesture_type, start_time, end_time, confidence, list_filter([initiator_id, target_person_id], lambda x: x is not null) from sf)),
pairs as (select a.video_id, a.place gaze_place, b.place gesture_place, a.start_time < b.end_time and b.start_time < a.end_time o, greatest(a.start_time, b.start_time) - least(a.end_time, b.end_time) apart from tl a join tl b on a.video_id = b.video_id and a.source = 'gaze' and b.source = 'gesture'
  where (a.start_time < b.end_time and b.start_time < a.end_time) or greatest(a.start_time, b.start_time) - least(a.end_time, b.end_time) <= 3)
"""


@query(f"{BASE} select video_id, gesture_key, gesture_type, start_time, end_time, confidence from sf")
def f5_gesture_filter(spark, sf_dir):
    return timeline.filter_gestures(gestures(spark, sf_dir)).select("video_id", "gesture_key", "gesture_type", "start_time", "end_time", "confidence")


@query(f"{BASE} select video_id, place, source, item, kind, start_time, end_time, confidence, array_to_string(persons, ',') persons from tl")
def e8_merge_timeline(spark, sf_dir):
    return merged(spark, sf_dir).select("video_id", F.col("place").cast("long").alias("place"), "source", "item", "kind", "start_time", "end_time", "confidence", F.array_join("persons", ",").alias("persons"))


@query(f"{BASE} select video_id, gaze_place, gesture_place, case when o then 'overlap' else 'adjacent' end relation, round(case when o then -apart else apart end, 2) as seconds from pairs")
def j4_cross_modal_pairs(spark, sf_dir):
    return timeline.cross_modal_pairs(merged(spark, sf_dir)).withColumns({c: F.col(c).cast("long") for c in ("gaze_place", "gesture_place")})


@query(f"{BASE}, n as (select *, row_number() over (partition by video_id order by start_time, end_time, event_id) n from e) select a.video_id, a.event_id item_a, b.event_id item_b, case when a.end_time > b.start_time then 'overlaps' else 'immediately_follows' end relation, round(case when a.end_time > b.start_time then least(a.end_time, b.end_time) - b.start_time else b.start_time - a.end_time end, 2) as seconds from n a join n b on a.video_id = b.video_id and a.n < b.n and b.start_time - a.end_time <= 3")
def j5_temporal_relations(spark, sf_dir):
    return timeline.temporal_relations(gaze_events(spark, sf_dir).withColumnRenamed("event_id", "item"))


@query(f"{BASE}, r as (select *, row_number() over (partition by video_id order by confidence desc, start_time, gesture_key) r from s), k as (select * from r where r <= 50) select video_id, gesture_key item, row_number() over (partition by video_id order by start_time, gesture_key) rank from k")
def t3_top_in_time(spark, sf_dir):
    return timeline.top_in_time(gestures(spark, sf_dir).withColumnRenamed("gesture_key", "item")).select("video_id", "item", F.col("rank").cast("long").alias("rank"))


@query(f"{BASE}, r as (select *, row_number() over (partition by video_id, gesture_type order by confidence desc, start_time, gesture_key) = 1 best from s), k as (select *, row_number() over (partition by video_id order by best desc, confidence desc, start_time, gesture_key) rank from r) select video_id, gesture_key, rank from k where rank <= 3")
def t5_fallback_sample(spark, sf_dir):
    return timeline.fallback_sample(gestures(spark, sf_dir)).select("video_id", "gesture_key", F.col("rank").cast("long").alias("rank"))


@query(f"{BASE}, p as (select tl.*, exists (select 1 from pairs q where q.video_id = tl.video_id and (q.gaze_place = tl.place or q.gesture_place = tl.place)) protected, row_number() over (partition by video_id, source, kind order by place) = 1 fst from tl), m as (select *, protected or fst must, count(*) over (partition by video_id) n, count(*) filter (protected or fst) over (partition by video_id) musts, row_number() over (partition by video_id order by (protected or fst), confidence desc, place) rk from p) select video_id, place, item from m where n <= 25 or must or rk <= 25 - musts")
def t6_cap(spark, sf_dir):
    """The cap alone, without the greedy dropping of doubles (e9)."""
    rows = merged(spark, sf_dir)
    held = timeline.paired_places(rows).withColumn("_p", F.lit(True))
    rows = rows.join(held, ["video_id", "place"], "left").withColumn("protected", F.coalesce("_p", F.lit(False)))
    return timeline.cap(rows).select("video_id", F.col("place").cast("long").alias("place"), "item")


@query()
def e9_filter_timeline(spark, sf_dir):
    return timeline.filter_timeline(merged(spark, sf_dir)).select("video_id", F.col("place").cast("long").alias("place"), "source", "item", "protected")


@query(f"{BASE}, pc as (select video_id, count(*) n from pairs group by 1) select video_id, count(*) filter (source = 'gaze') gaze_events, count(*) filter (source = 'gesture') gestures, coalesce(max(n), 0) pairs, min(start_time) first_start, max(end_time) last_end, max(end_time) + 5 duration from tl left join pc using (video_id) group by video_id")
def a18_graph_summary(spark, sf_dir):
    rows = merged(spark, sf_dir)
    return timeline.summary(rows, timeline.cross_modal_pairs(rows))


@query(f"{BASE} select video_id, array_to_string(list_sort(list(distinct p)), ',') persons from (select video_id, unnest(persons) p from tl) group by video_id")
def a19_person_ids(spark, sf_dir):
    return timeline.person_ids(merged(spark, sf_dir)).withColumn("persons", F.array_join("persons", ","))


@query(f"{BASE}, g as (select distinct video_id, dense_rank() over (partition by video_id order by frame_pos) - 1 pos, ts from ({adapters.sql(adapters.GAZE)})) select g.video_id, pos, gesture_key item from g join s on s.video_id = g.video_id and ts between start_time and end_time")
def j16_active_events(spark, sf_dir):
    frames = features.observed(gaze(spark, sf_dir)).select("video_id", F.col("pos").cast("long").alias("pos"), "ts").distinct()
    return timeline.active_at(frames, gestures(spark, sf_dir).withColumnRenamed("gesture_key", "item"))


@query(f"{BASE}, c as (select gt.video_id, gt.gt_key, s.gesture_type, s.start_time, s.gesture_key, least(gt.end_time, s.end_time) - greatest(gt.start_time, s.start_time) sec from gt join s on s.video_id = gt.video_id and s.start_time < gt.end_time and gt.start_time < s.end_time), b as (select *, row_number() over (partition by video_id, gt_key order by sec desc, start_time, gesture_key) r from c), m as (select gt.gesture_type gt_type, b.gesture_type pred_type from gt left join b on b.video_id = gt.video_id and b.gt_key = gt.gt_key and r = 1 union all select null, gesture_type from s where not exists (select 1 from b where r = 1 and b.video_id = s.video_id and b.gesture_key = s.gesture_key)) select gt_type, pred_type, count(*) n from m group by all")
def a13_confusion(spark, sf_dir):
    return evaluate.confusion(gt(spark, sf_dir), gestures(spark, sf_dir))


@query()
def e14_evaluate_gestures(spark, sf_dir):
    g, p = gt(spark, sf_dir), gestures(spark, sf_dir)
    return evaluate.scores(g, p, evaluate.greedy_match(g, p))


# --- reports ------------------------------------------------------------------------------------------------------


@query(f"{BASE}, d as (select 'd' || (cast(substr(video_id, 2) as bigint) % 7) dataset, * from e), t as (select unnest([0e0, 6e-1, 7e-1, 8e-1, 9e-1]) threshold) select threshold, dataset, event_type, count(*) events, count(distinct video_id) videos from t join d on confidence >= threshold group by threshold, cube(dataset, event_type)")
def a8_threshold_cube(spark, sf_dir):
    return reports.threshold_cube(reports.with_dataset(gaze_events(spark, sf_dir)))


@query(f"{BASE}, d as (select 'd' || (cast(substr(video_id, 2) as bigint) % 7) dataset, * from e) select dataset, count(distinct video_id) videos, count(*) filter (event_type = 'sudden_gaze_shift') sudden_gaze_shift, count(*) filter (event_type = 'joint_attention') joint_attention, count(*) filter (event_type = 'gaze_following') gaze_following, count(*) filter (event_type = 'attention_capture') attention_capture, count(*) filter (event_type = 'mutual_gaze') mutual_gaze from d group by rollup(dataset)")
def a7_dataset_statistics(spark, sf_dir):
    return reports.dataset_statistics(reports.with_dataset(gaze_events(spark, sf_dir)))


@query(f"with g as ({adapters.sql(adapters.GAZE)}), p as (select video_id, count(distinct person_id) persons from g group by 1), n as (select persons, row_number() over (order by persons) r, count(*) over () c from p) select persons, count(*) videos, (select persons from n where r = c//2 + 1) upper_median from p group by persons")
def a9_person_counts(spark, sf_dir):
    return reports.person_counts(gaze(spark, sf_dir))


@query("select s_nationkey video, s_suppkey segment, coalesce(sum(case when s_acctbal >= 0 then 60 + s_suppkey % 60 else 120 end) over (partition by s_nationkey order by s_suppkey rows between unbounded preceding and 1 preceding), 0) + 0e0 offset_seconds from supplier")
def w8_segment_offsets(spark, sf_dir):
    from ..operators.islands import offsets

    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("video"), F.col("s_suppkey").alias("segment"), F.when(F.col("s_acctbal") >= 0, 60 + F.col("s_suppkey") % 60).alias("seconds"))
    return offsets(rows, ["video"], "segment", F.coalesce(F.col("seconds"), F.lit(120)).cast("double"), "offset_seconds").drop("seconds")


@query("with q as (select conv_id*100 + turn question_id, case when length(text) < 150 then 'short' when length(text) < 400 then 'middle' else 'long' end subcategory, role difficulty from conversations), r as (select *, row_number() over (partition by subcategory order by md5(cast(question_id as varchar)), question_id) rank from q) select question_id, subcategory, rank from r where rank <= 100")
def t8_balanced_sample(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), F.when(F.length("text") < 150, "short").when(F.length("text") < 400, "middle").otherwise("long").alias("subcategory"))
    w = Window.partitionBy("subcategory").orderBy(F.md5(F.col("question_id").cast("string")), "question_id")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 100")
