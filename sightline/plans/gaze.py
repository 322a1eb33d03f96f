"""Queries on gaze rows, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events, features
from ..session import save_clustered
from ..sources import adapters

QUERIES, ORACLE = {}, {}


def gaze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.rows(spark, sf_dir, adapters.GAZE)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names})


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


BASE = f"""with g as ({adapters.sql(adapters.GAZE)}),
o as (select *, dense_rank() over (partition by video_id order by frame_pos) - 1 pos, row_number() over (partition by video_id, person_id order by frame_pos) - 1 obs_pos,
  coalesce(inout, false) and gx is not null and gy is not null valid from g),
n as (select *, last_value(case when valid then obs_pos end ignore nulls) over b po, last_value(case when valid then ts end ignore nulls) over b pt, last_value(case when valid then gx end ignore nulls) over b px, last_value(case when valid then gy end ignore nulls) over b py,
  first_value(case when valid then obs_pos end ignore nulls) over a no, first_value(case when valid then ts end ignore nulls) over a nt, first_value(case when valid then gx end ignore nulls) over a nx, first_value(case when valid then gy end ignore nulls) over a ny from o
  window b as (partition by video_id, person_id order by obs_pos rows between unbounded preceding and 1 preceding), a as (partition by video_id, person_id order by obs_pos rows between 1 following and unbounded following)),
m as (select *, case when valid then 'measured' when po is not null and no is not null then case when nt - pt > 3 then 'null_scene_cut' when no - po - 1 <= 3 then 'linear_interpolation' when no - po - 1 <= 10 then 'carry_forward' else 'null_gap_too_long' end
  when po is not null then case when ts - pt > 3 then 'null_scene_cut' when obs_pos - po <= 10 then 'carry_forward' else 'null_no_valid' end
  when no is not null then case when nt - ts > 3 then 'null_scene_cut' when no - obs_pos <= 10 then 'carry_backward' else 'null_no_valid' end else 'null_no_valid' end imethod from n),
i as (select *, case imethod when 'measured' then gx when 'linear_interpolation' then px + (obs_pos - po) / (no - po) * (nx - px) when 'carry_forward' then px when 'carry_backward' then nx end ix,
  case imethod when 'measured' then gy when 'linear_interpolation' then py + (obs_pos - po) / (no - po) * (ny - py) when 'carry_forward' then py when 'carry_backward' then ny end iy,
  case imethod when 'measured' then 1e0 when 'linear_interpolation' then 1e0 - 1e-1 * (no - po - 1) when 'carry_forward' then 5e-1 * exp(-2e-1 * (obs_pos - po)) when 'carry_backward' then 5e-1 * exp(-2e-1 * (no - obs_pos)) else 0e0 end iconf from m),
l as (select *, lag(ix) over w lx, lag(iy) over w ly, lag(ts) over w lt, lag(iconf) over w lc from i window w as (partition by video_id, person_id order by obs_pos)),
v as (select *, case when obs_pos = 0 then null when lx is not null and ix is not null and ts > lt then sqrt((ix-lx)*(ix-lx) + (iy-ly)*(iy-ly)) / (ts - lt) else 0e0 end velocity,
  case when obs_pos = 0 then null when lx is not null and ix is not null and ts > lt then least(iconf, lc) else 0e0 end velocity_conf from l),
r as (select v.*, case when v.face_detected then case when v.valid then v.gx else v.ix end end x, case when v.face_detected then case when v.valid then v.gy else v.iy end end y, case when v.face_detected then v.iconf else 0e0 end conf,
  case when v.face_detected then v.imethod else 'no_face' end method, v.face_detected and v.fx1 is not null face, case when v.pos > 0 then coalesce(u.velocity, 0e0) else 0e0 end fv
  from v left join v u on u.video_id = v.video_id and u.person_id = v.person_id and u.obs_pos = v.pos),
k as (select *, face and x is not null and conf >= 3e-1 good from r),
kc as (select *, sum(case when good then x*conf end) over f / sum(case when good then conf end) over f cx, sum(case when good then y*conf end) over f / sum(case when good then conf end) over f cy from k window f as (partition by video_id, pos)),
f as (select video_id, pos, min(frame_idx) frame_idx, min(ts) ts, count(*) num_persons, count(*) filter (face) num_faces,
  case when count(*) filter (good) >= 2 then exp(-3e0 * median(case when good then sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy)) end)) * avg(case when good then conf end) else 0e0 end convergence, max(cx) center_x, max(cy) center_y,
  list_sort(list(person_id) filter (face)) present from kc group by video_id, pos)
"""


@query(f"{BASE} select video_id, frame_pos, person_id, pos, obs_pos, valid from o")
def f1_valid_gaze(spark, sf_dir):
    return features.observed(gaze(spark, sf_dir)).select("video_id", "frame_pos", "person_id", F.col("pos").cast("long"), F.col("obs_pos").cast("long"), "valid")


@query(f"{BASE} select video_id, frame_pos, person_id, imethod, round(ix,6)+0e0 ix, round(iy,6)+0e0 iy, round(iconf,6) iconf from i")
def w1_gap_fill(spark, sf_dir):
    return rounded(features.fill_gaps(features.observed(gaze(spark, sf_dir))), "ix", "iy", "iconf").select("video_id", "frame_pos", "person_id", "imethod", "ix", "iy", "iconf")


@query(f"{BASE} select video_id, frame_pos, person_id, round(velocity,6) velocity, round(velocity_conf,6) velocity_conf from v")
def w2_velocity(spark, sf_dir):
    rows = features.velocities(features.fill_gaps(features.observed(gaze(spark, sf_dir))))
    return rounded(rows, "velocity", "velocity_conf").select("video_id", "frame_pos", "person_id", "velocity", "velocity_conf")


@query(f"{BASE}, q as (select *, (fx1+fx2)/2 cx, (fy1+fy2)/2 cy from v), z as (select *, sqrt((cx-lag(cx) over w)*(cx-lag(cx) over w)+(cy-lag(cy) over w)*(cy-lag(cy) over w)) jump, ts - lag(ts) over w dt from q window w as (partition by video_id, person_id order by obs_pos)) select video_id, frame_pos, person_id, round(jump,6) face_jump, coalesce(jump > 3e-1, false) is_scene_cut, case when jump <= 3e-1 and dt > 0 then round(jump/dt,6) end face_velocity from z")
def w3_face_motion(spark, sf_dir):
    return rounded(features.face_motion(features.observed(gaze(spark, sf_dir))), "face_jump", "face_velocity").select("video_id", "frame_pos", "person_id", "face_jump", "is_scene_cut", "face_velocity")


@query(f"{BASE} select video_id, frame_pos, person_id, method, round(x,6)+0e0 x, round(y,6)+0e0 y, round(conf,6) conf, face, round(fv,6) frame_velocity from r")
def f2_frame_rows(spark, sf_dir):
    """The gaze choice of each frame, with the velocity looked up by position (J1)."""
    return rounded(features.features(gaze(spark, sf_dir)), "x", "y", "conf", "frame_velocity").select("video_id", "frame_pos", "person_id", "method", "x", "y", "conf", "face", "frame_velocity")


@query(f"{BASE}, s as (select *, case when iconf > 5e-1 and ix is not null then ix end sx, case when iconf > 5e-1 and ix is not null then iy end sy from v), c as (select *, avg(sx) over w mx, avg(sy) over w my from s window w as (partition by video_id, person_id)) select video_id, person_id, count(*) track_length, round(coalesce(avg(velocity),0),6) mean_velocity, round(coalesce(max(velocity),0),6) max_velocity, round(coalesce(stddev_pop(velocity),0),6) velocity_std, round(coalesce(avg(sx),0),6) mean_gaze_x, round(coalesce(avg(sy),0),6) mean_gaze_y, round(coalesce(stddev_pop(sqrt((mx-sx)*(mx-sx)+(my-sy)*(my-sy))),0),6) gaze_spread from c group by all")
def a1_person_features(spark, sf_dir):
    out = features.person_features(features.velocities(features.fill_gaps(features.observed(gaze(spark, sf_dir)))))
    return rounded(out, "mean_velocity", "max_velocity", "velocity_std", "mean_gaze_x", "mean_gaze_y", "gaze_spread")


@query(f"{BASE} select video_id, pos, num_persons, num_faces, round(convergence,6) convergence, round(center_x,6) center_x, round(center_y,6) center_y, array_to_string(present, ',') present from f")
def a2_convergence(spark, sf_dir):
    out = features.frame_features(features.features(gaze(spark, sf_dir)))
    return rounded(out, "convergence", "center_x", "center_y").select("video_id", F.col("pos").cast("long").alias("pos"), "num_persons", "num_faces", "convergence", "center_x", "center_y", F.when(F.size("present") > 0, F.array_join("present", ",")).alias("present"))


@query(f"{BASE} select video_id, count(*) frames, round(coalesce(avg(convergence) filter (num_faces >= 2),0),6) mean_convergence, round(coalesce(max(convergence) filter (num_faces >= 2),0),6) max_convergence from f group by video_id")
def a4_video_features(spark, sf_dir):
    return rounded(features.video_features(features.frame_features(features.features(gaze(spark, sf_dir)))), "mean_convergence", "max_convergence")


@query(f"{BASE} select video_id, person_id, min(frame_idx) first_frame, max(frame_idx) last_frame, count(distinct frame_idx) track_length, round_even(100e0*count(*) filter (face_detected)/count(*),1) face_pct, round_even(100e0*count(*) filter (valid)/count(*),1) inframe_pct from o group by all")
def a5_person_summary(spark, sf_dir):
    return features.person_summary(features.observed(gaze(spark, sf_dir)))


@query(f"{BASE} select a.video_id, a.pos, a.person_id person_a, b.person_id person_b, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)),6) distance from k a join k b on a.video_id = b.video_id and a.pos = b.pos and a.person_id < b.person_id where a.good and b.good")
def j2_pair_distances(spark, sf_dir):
    return rounded(features.pair_distances(features.features(gaze(spark, sf_dir))), "distance").withColumn("pos", F.col("pos").cast("long"))


@query(f"{BASE}, t as (select video_id, person_id, ts, velocity, row_number() over (partition by video_id order by velocity desc, person_id, obs_pos) rank from v where velocity > 5e-1 and velocity_conf >= 5e-1) select video_id, person_id, ts, round(velocity,6) velocity, rank from t where rank <= 50")
def t1_top_velocities(spark, sf_dir):
    rows = features.velocities(features.fill_gaps(features.observed(gaze(spark, sf_dir))))
    return rounded(features.top_velocities(rows), "velocity").withColumn("rank", F.col("rank").cast("long"))


@query(f"{BASE} select video_id, count(distinct person_id) persons from o group by video_id")
def a24_unique_persons(spark, sf_dir):
    return gaze(spark, sf_dir).groupBy("video_id").agg(F.countDistinct("person_id").alias("persons"))


# --- events -------------------------------------------------------------------------------------------------------

SHIFT = """, h as (select *, min(pos*10+person_id) over (partition by video_id, person_id) met from r where face and fv > 7e-1),
h2 as (select *, case when ts - lag(ts) over (partition by video_id, person_id order by pos) < 6e-1 then 0 else 1 end nw from h),
h3 as (select *, sum(nw) over (partition by video_id, person_id order by pos) isl from h2),
h4 as (select video_id, person_id, met, min(ts) s, max(ts) e, min(frame_idx) sf, max(frame_idx) ef, max(fv) mv, count(*) n from h3 group by video_id, person_id, met, isl),
shift as (select video_id, row_number() over (partition by video_id order by met, s) - 1 event_id, 'sudden_gaze_shift' event_type, s start_time, e end_time, sf start_frame, ef end_frame, least(1e0, mv/14e-1) confidence, cast(person_id as varchar) persons from h4 where e - s between 5e-1 and 15e-1)"""
JOINT = """, j1 as (select *, lag(present) over w pp, lag(ts) over w pt from f where convergence >= 6e-1 and num_faces >= 2 window w as (partition by video_id order by pos)),
j2 as (select *, sum(case when pt is null or ts - pt >= 6e-1 or len(list_intersect(present, pp)) < least(len(present), len(pp)) * 7e-1 then 1 else 0 end) over (partition by video_id order by pos) isl from j1),
j3 as (select video_id, isl, min(ts) s, max(ts) e, min(frame_idx) sf, max(frame_idx) ef, min(pos) pos, avg(convergence) c, arg_max(center_x, convergence*1e6 - pos*1e-6) cx, arg_max(center_y, convergence*1e6 - pos*1e-6) cy from j2 group by video_id, isl having max(ts) - min(ts) >= 5e-1),
j4 as (select j3.video_id, s, e, sf, ef, c, list_sort(list(distinct r.person_id)) who from j3 join r on r.video_id = j3.video_id and r.pos = j3.pos where r.face and r.x is not null and sqrt((r.x-cx)*(r.x-cx)+(r.y-cy)*(r.y-cy)) < 2e-1 group by all having count(distinct r.person_id) >= 2),
joint_attention as (select video_id, row_number() over (partition by video_id order by s) + 999 event_id, 'joint_attention' event_type, s start_time, e end_time, sf start_frame, ef end_frame, c confidence, array_to_string(who, ',') persons from j4)"""
FOLLOW = """, w1 as (select *, min(pos*10+person_id) over (partition by video_id, person_id) met from r where x is not null and conf >= 5e-1),
w2 as (select a.video_id, a.person_id a, b.person_id b, a.met ma, b.met mb, a.ts ta, b.ts tb, a.frame_idx fa, b.frame_idx fb, sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) d from w1 a join w1 b on a.video_id = b.video_id and a.met < b.met and b.ts - a.ts between 1 and 2),
w3 as (select *, 1e0 - d/3e-2 c from w2 where d < 3e-2 and 1e0 - d/3e-2 >= 9e-1),
w4 as (select *, max(tb) over (partition by video_id, a, b order by ta, tb rows between unbounded preceding and 1 preceding) reach from w3),
w5 as (select *, sum(case when reach is null or ta > reach + 1 then 1 else 0 end) over (partition by video_id, a, b order by ta, tb rows unbounded preceding) isl from w4),
w6 as (select video_id, a, b, ma, mb, min(ta) s, max(tb) e, min(fa) sf, max(fb) ef, max(c) c from w5 group by video_id, a, b, ma, mb, isl),
following as (select video_id, row_number() over (partition by video_id order by ma, mb, s) + 1999 event_id, 'gaze_following' event_type, s start_time, e end_time, sf start_frame, ef end_frame, c confidence, a || ',' || b persons from w6)"""
CAPTURE = """, c1 as (select video_id, pos, min(ts) ts, min(frame_idx) frame_idx, list_sort(list(person_id) filter (face)) present, list_sort(list(person_id) filter (face and fv > 4e-1)) fast from r group by video_id, pos having count(*) filter (face and fv > 4e-1) >= 3),
c2 as (select *, lag(present) over w pp, lag(ts) over w pt from c1 window w as (partition by video_id order by pos)),
c3 as (select *, sum(case when pt is null or ts - pt >= 5e-1 or len(list_intersect(present, pp)) < least(len(present), len(pp)) * 7e-1 then 1 else 0 end) over (partition by video_id order by pos) isl from c2),
c4 as (select video_id, isl, avg(mv) mv from (select c3.video_id, isl, person_id, max(fv) mv from c3 join r on r.video_id = c3.video_id and r.pos = c3.pos group by all) group by video_id, isl),
c5 as (select c3.video_id, c3.isl, min(ts) s, max(ts) e, min(frame_idx) sf, max(frame_idx) ef, arg_min(fast, pos) who, any_value(mv) mv from c3 join c4 on c3.video_id = c4.video_id and c3.isl = c4.isl group by c3.video_id, c3.isl),
capture as (select video_id, row_number() over (partition by video_id order by s) + 2999 event_id, 'attention_capture' event_type, s start_time, e end_time, sf start_frame, ef end_frame, least(1e0, mv/4e-1) confidence, array_to_string(who, ',') persons from c5)"""
MUTUAL = """, m1 as (select a.video_id, a.pos, a.ts, a.frame_idx, a.person_id a, b.person_id b from r a join r b on a.video_id = b.video_id and a.pos = b.pos and a.person_id < b.person_id
  where a.face and b.face and a.method = 'measured' and b.method = 'measured' and a.x between b.fx1 - 2e-2 and b.fx2 + 2e-2 and a.y between b.fy1 - 2e-2 and b.fy2 + 2e-2 and b.x between a.fx1 - 2e-2 and a.fx2 + 2e-2 and b.y between a.fy1 - 2e-2 and a.fy2 + 2e-2),
m2 as (select *, min(pos*100 + a*10 + b) over (partition by video_id, a, b) met, case when ts - lag(ts) over (partition by video_id, a, b order by pos) < 15e-1 then 0 else 1 end nw from m1),
m3 as (select *, sum(nw) over (partition by video_id, a, b order by pos) isl from m2),
m4 as (select video_id, a, b, met, min(ts) s, max(ts) e, min(frame_idx) sf, max(frame_idx) ef, count(*) n from m3 group by video_id, a, b, met, isl having max(ts) - min(ts) >= 1),
mutual as (select video_id, row_number() over (partition by video_id order by met, s) + 3999 event_id, 'mutual_gaze' event_type, s start_time, e end_time, sf start_frame, ef end_frame, least(1e0, 5e-1 + 1e-1*n) confidence, a || ',' || b persons from m4)"""
TOLD = "video_id, cast(event_id as bigint) event_id, event_type, start_time, end_time, start_frame, end_frame, round(confidence,6) confidence, persons"
ALL = f"{BASE}{SHIFT}{JOINT}{FOLLOW}{CAPTURE}{MUTUAL}, every as (select * from shift union all select * from joint_attention union all select * from following union all select * from capture union all select * from mutual)"


def told(df: DataFrame) -> DataFrame:
    return rounded(df, "confidence").select("video_id", "event_id", "event_type", "start_time", "end_time", "start_frame", "end_frame", "confidence", F.array_join("persons", ",").alias("persons"))


@query(f"{BASE}{SHIFT} select {TOLD} from shift")
def e2_sudden_gaze_shift(spark, sf_dir):
    return told(events.sudden_gaze_shifts(features.features(gaze(spark, sf_dir))))


@query(f"{BASE}{JOINT} select {TOLD} from joint_attention")
def e3_joint_attention(spark, sf_dir):
    rows = features.features(gaze(spark, sf_dir))
    return told(events.joint_attention(rows, features.frame_features(rows)))


@query(f"{BASE}{FOLLOW} select {TOLD} from following")
def e4_gaze_following(spark, sf_dir):
    return told(events.gaze_following(features.features(gaze(spark, sf_dir))))


@query(f"{BASE}{CAPTURE} select {TOLD} from capture")
def e5_attention_capture(spark, sf_dir):
    return told(events.attention_capture(features.features(gaze(spark, sf_dir))))


@query(f"{BASE}{MUTUAL} select {TOLD} from mutual")
def e6_mutual_gaze(spark, sf_dir):
    return told(events.mutual_gaze(features.features(gaze(spark, sf_dir))))


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    # five detectors read them, each by video
    rows = save_clustered(features.features(gaze(spark, sf_dir)), "features", "video_id")
    return events.all_events(rows, save_clustered(features.frame_features(rows), "frames", "video_id"))


@query(f"{ALL} select {TOLD} from every")
def e7_all_events(spark, sf_dir):
    return told(detected(spark, sf_dir))


@query(f"{ALL} select video_id, event_type, count(*) events from every group by all")
def a6_event_counts(spark, sf_dir):
    return detected(spark, sf_dir).groupBy("video_id", "event_type").agg(F.count("*").alias("events"))


@query(f"{ALL}, t as (select *, row_number() over (partition by video_id order by confidence desc, start_time, event_id) rank from every where confidence >= 75e-2) select video_id, cast(event_id as bigint) event_id, rank from t where rank <= 15")
def t4_candidates(spark, sf_dir):
    return events.candidates(detected(spark, sf_dir)).select("video_id", "event_id", "rank")


@query(f"{BASE} select video_id, pos, num_faces, round(convergence,6) convergence from f where convergence > 7e-1 and num_faces >= 2")
def f16_high_convergence(spark, sf_dir):
    out = features.high_convergence(features.frame_features(features.features(gaze(spark, sf_dir))))
    return rounded(out, "convergence").select("video_id", F.col("pos").cast("long").alias("pos"), "num_faces", "convergence")
