"""Queries on evaluation and reports, each with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, reports
from ..operators.islands import offsets
from ..sources import adapters
from .gaze import gaze
from .timeline import BASE, gaze_events, gestures, gt

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Segments of the gestures' videos, of 20 to 26 seconds, 40 where unknown.
SEGMENTS = "select concat('v', lpad(cast(s_suppkey % 40 as varchar(10)), 5, '0')) video_id, cast(floor(s_suppkey / 40) as bigint) + 1 segment, case when s_acctbal >= 0 then 20e0 + s_suppkey % 7 else 40e0 end as seconds from {supplier}"
LABELS = "select cast(floor(event_id/500) as bigint) video, (event_id % 500) * 2 + case when event_id % 50 >= 40 then 7 else 0 end frame, case event_type when 'view' then 'mutual' when 'click' then 'share' when 'signup' then 'refer' when 'purchase' then 'single' else 'none' end kind from {events}"


def _sql(text: str) -> str:
    return text.format(supplier="supplier", events="events")


def _rows(spark, sf_dir, text):
    names = [n for n in ("supplier", "events") if "{" + n + "}" in text]
    return spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


@query("with v as (select distinct s_suppkey k from supplier), a as (select case k % 4 when 0 then concat('a_b ', cast(k as varchar(9))) when 1 then concat('a_b_', cast(k as varchar(9))) when 2 then concat('a.b_', cast(k as varchar(9))) else concat('z', cast(k as varchar(9))) end video_id from v), g as (select case k % 3 when 0 then concat('a_b_', cast(k as varchar(9))) when 1 then concat('a b ', cast(k as varchar(9))) else concat('a.b.', cast(k as varchar(9))) end gt_video from v) select video_id, coalesce((select min(gt_video) from g where gt_video = video_id), (select min(gt_video) from g where gt_video = replace(video_id, '_', ' ')), (select min(gt_video) from g where replace(replace(gt_video, ' ', '_'), '.', '_') = replace(replace(video_id, ' ', '_'), '.', '_'))) gt_video from a")
def j7_match_keys(spark, sf_dir):
    k = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k")).distinct()
    name = lambda *p: F.concat(F.lit(p[0]), F.col("k").cast("string"))
    videos = k.select(F.when(F.col("k") % 4 == 0, name("a_b ")).when(F.col("k") % 4 == 1, name("a_b_")).when(F.col("k") % 4 == 2, name("a.b_")).otherwise(name("z")).alias("video_id"))
    keys = k.select(F.when(F.col("k") % 3 == 0, name("a_b_")).when(F.col("k") % 3 == 1, name("a b ")).otherwise(name("a.b.")).alias("gt_video"))
    return evaluate.match_keys(videos, keys)


def _located(spark, sf_dir, rows):
    segments = offsets(_rows(spark, sf_dir, SEGMENTS), ["video_id"], "segment", F.col("seconds"), "offset_seconds")
    out = evaluate.local_times(rows, segments)
    return out.withColumn("part", evaluate.part_of(F.col("local_time")))


LOCAL = f"{BASE}, sg as ({_sql(SEGMENTS)}), so as (select video_id, segment, coalesce(sum(seconds) over (partition by video_id order by segment rows between unbounded preceding and 1 preceding), 0) o from sg), l as (select s.*, coalesce((select max_by(segment, o) from so where so.video_id = s.video_id and o <= s.start_time), 1) segment, start_time - coalesce((select max(o) from so where so.video_id = s.video_id and o <= s.start_time), 0) local_time from s)"


@query(f"{LOCAL} select video_id, gesture_key, segment, round(local_time, 6) local_time, case when local_time >= 0 and local_time < 40 then '0-40s' when local_time >= 40 and local_time < 80 then '40-80s' when local_time >= 80 and local_time < 120 then '80-120s' end part from l")
def j8_local_times(spark, sf_dir):
    return _located(spark, sf_dir, gestures(spark, sf_dir)).select("video_id", "gesture_key", "segment", F.round("local_time", 6).alias("local_time"), "part")


@query()
def a12_scores_by_part(spark, sf_dir):
    """Greedy matching within each part of the segments; held against a loop."""
    return evaluate.scores_by_part(_located(spark, sf_dir, gt(spark, sf_dir)), _located(spark, sf_dir, gestures(spark, sf_dir)))


@query()
def j13_keep_matched(spark, sf_dir):
    """Greedy matching and the sample of three; held against a loop."""
    return evaluate.keep_matched(gestures(spark, sf_dir), gt(spark, sf_dir)).select("video_id", "gesture_key", "gesture_type", "choice")


W10 = f"with k as ({_sql(LABELS)}), fr as (select *, row_number() over (partition by video order by frame) place from (select video, frame, list(distinct kind) kinds from k group by 1, 2)), e as (select video, frame, place, unnest(kinds) kind from fr), n as (select *, case when lag(frame) over w is null or place - lag(place) over w > 1 or frame - lag(frame) over w > 5 then 1 else 0 end nw from e window w as (partition by video, kind order by frame)), i as (select *, sum(nw) over (partition by video, kind order by frame) island from n), seg as (select video, kind, min(frame) first_frame, max(frame) last_frame, count(*) frames from i group by video, kind, island having count(*) >= 2)"


@query(f"{W10} select * from seg")
def w10_label_segments(spark, sf_dir):
    return reports.label_segments(_rows(spark, sf_dir, LABELS))


def _gaze_sides(spark, sf_dir):
    segs = reports.label_segments(_rows(spark, sf_dir, LABELS)).where("kind <> 'none'")
    g = segs.select(F.concat(F.lit("v"), F.lpad(F.col("video").cast("string"), 5, "0")).alias("video_id"), F.col("first_frame").alias("gt_no"), "kind", F.col("first_frame").alias("start_frame"), F.col("last_frame").alias("end_frame"))
    p = gaze_events(spark, sf_dir).select("video_id", "event_id", "event_type", F.floor(F.col("start_time") * 8).alias("start_frame"), F.floor(F.col("end_time") * 8).alias("end_frame"))
    return g, p


@query()
def e15_evaluate_gaze(spark, sf_dir):
    """Greedy matching by overlap of frames; held against a loop."""
    g, p = _gaze_sides(spark, sf_dir)
    return evaluate.gaze_scores(g, p, evaluate.match_gaze(g, p))


@query(f"{W10}, g as (select concat('v', lpad(cast(video as varchar(10)),5,'0')) video_id, count(*) filter (kind in ('mutual','share','refer')) gt_segments from seg where kind <> 'none' group by 1), p as (select video_id, count(*) filter (event_type in ('mutual_gaze','joint_attention','gaze_following')) events from ({adapters.sql(adapters.GAZE_EVENTS)}) group by 1) select coalesce(g.video_id, p.video_id) video_id, coalesce(gt_segments, 0) gt_segments, coalesce(events, 0) events, case when events is null then 'gt' when gt_segments is null then 'pred' else 'both' end side from g full outer join p on g.video_id = p.video_id")
def j17_sides(spark, sf_dir):
    return evaluate.gaze_counts(*_gaze_sides(spark, sf_dir))


D = f"{BASE}, d as (select 'd' || (cast(substr(video_id, 2) as bigint) % 7) dataset, * from e), b as (select * exclude (dataset), unnest([dataset, null]) dataset from d)"


@query(f"{D}, n as (select dataset, video_id, count(*) n from b group by all), v as (select dataset, avg(n) mean_events, median(n) median_events, min(n) least_events, max(n) most_events from n group by 1), k as (select dataset, event_type, count(*) events from b group by all) select k.dataset, event_type, events, 100e0 * events / sum(events) over (partition by k.dataset) as percent, mean_events, median_events, least_events, most_events from k join v on k.dataset is not distinct from v.dataset")
def a6_event_statistics(spark, sf_dir):
    return reports.event_statistics(reports.with_dataset(gaze_events(spark, sf_dir)))


def _videos(spark, sf_dir):
    rows = gaze_events(spark, sf_dir).groupBy("video_id").agg(F.max("end_time").alias("seconds"), F.count("*").alias("frames"))
    return reports.with_dataset(rows)


VIDEOS = f"{D}, vids as (select video_id, dataset, max(end_time) as seconds, count(*) frames from d group by all)"
TYPES = ", ".join(f"coalesce({t}, 0) {t}" for t in reports.TYPES)
COUNTS = ", ".join(f"count(*) filter (event_type = '{t}') {t}" for t in reports.TYPES)


@query(f"{VIDEOS}, v as (select dataset, count(*) videos, avg(seconds) mean_seconds, sum(seconds) / 3600 as hours from vids group by rollup(dataset)), c as (select dataset, count(*) events, {COUNTS} from d group by rollup(dataset)) select v.*, events, {TYPES}, events / videos events_of_video, 100e0 * events / (select count(*) from d) as percent from v join c on v.dataset is not distinct from c.dataset")
def a7_dataset_table(spark, sf_dir):
    return reports.dataset_table(_videos(spark, sf_dir), reports.with_dataset(gaze_events(spark, sf_dir)))


@query(f"{D}, t as (select unnest([0e0, 6e-1, 7e-1, 8e-1, 9e-1]) threshold) select threshold, b.dataset, count(*) events, count(distinct video_id) videos, count(*) / count(distinct video_id) average from t join b on confidence >= threshold group by threshold, b.dataset")
def a8_threshold_averages(spark, sf_dir):
    return reports.threshold_averages(reports.with_dataset(gaze_events(spark, sf_dir)))


PERSONS = f"with g as ({adapters.sql(adapters.GAZE)}), pp as (select video_id, person_id, 100e0 * count(*) filter (face_detected) / count(*) as pct from g group by all), pv as (select video_id, count(*) filter (pct >= 90) persons from pp group by 1)"


@query(f"{PERSONS}, r as (select persons, row_number() over (order by persons) n, count(*) over () c from pv) select min(persons) least, max(persons) most, avg(persons) mean, (select persons from r where n = c // 2 + 1) upper_median from pv")
def a9_person_statistics(spark, sf_dir):
    return reports.person_statistics(reports.persons_of_videos(gaze(spark, sf_dir), 90.0))


@query(f"{PERSONS} select video_id, persons, persons <= 3 keep from pv")
def f8_route_by_persons(spark, sf_dir):
    return reports.route_by_persons(reports.persons_of_videos(gaze(spark, sf_dir), 90.0), 3)


@query(f"{PERSONS} select video_id, persons from pv where persons > 1 order by persons desc, video_id limit 20")
def t9_largest(spark, sf_dir):
    return reports.largest(reports.persons_of_videos(gaze(spark, sf_dir), 90.0), 1)


@query(f"{VIDEOS} select dataset, count(*) videos, sum(frames) / 2e0 as seconds, sum(frames) / 7200e0 as hours, sum(frames) / 2e0 / count(*) mean_seconds from vids group by rollup(dataset)")
def a10_duration_statistics(spark, sf_dir):
    return reports.duration_statistics(_videos(spark, sf_dir))


@query("select case when grouping(o_orderpriority) = 0 then o_orderpriority end dataset, count(*) filter (o_orderstatus = 'F') f, count(*) filter (o_orderstatus = 'O') o, count(*) filter (o_orderstatus = 'P') p from orders group by rollup(o_orderpriority)")
def a23_outcomes(spark, sf_dir):
    jobs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("state"))
    return reports.outcomes(jobs, ["F", "O", "P"]).withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


@query(f"with g as ({adapters.sql(adapters.GAZE)}), r as (select *, dense_rank() over (partition by video_id order by frame_idx) r from g) select video_id, frame_idx, person_id from r where r <= 10")
def t11_first_frames(spark, sf_dir):
    return reports.first_frames(gaze(spark, sf_dir), 10).select("video_id", "frame_idx", "person_id")


@query()
def t7_sample_videos(spark, sf_dir):
    """A tenth of the videos by hashes; which ones depends on the hash alone."""
    return reports.sample_videos(gaze_events(spark, sf_dir).select("video_id").distinct(), ratio=0.1)
