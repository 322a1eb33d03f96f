"""Gaze, gesture and event rows derived from the test tables: one SQL text for each, valid in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GAZE = """
with a as (select event_id n, event_type et, value v, cast(floor(event_id/240) as bigint) vid, event_id % 240 k from {events}),
b as (select n, et, v, vid, cast(floor(k/4) as bigint) frame_pos, k % 4 p from a),
c as (select *, cast(floor(frame_pos/10) as bigint) % 6 ph, frame_pos % 10 j,
  ((n*7919) % 1000)/1e3 - 5e-1 nx, ((n*104729) % 1000)/1e3 - 5e-1 ny, p + 1 - 2*(p % 2) q from b),
d as (select *, 125e-3 + 25e-2*p + case when ph=5 and j>=5 and p=0 then 4e-1 else 0e0 end fx, 3e-1 fy,
  case when ph=0 then 5e-1+2e-2*nx when ph=1 then 125e-3+25e-2*q+4e-2*nx
       when ph=2 then case when p=0 then case when j in (4,6) then 9e-1 else 1e-1 end else 2e-1+2e-1*p end
       when ph=3 then case when p=0 then 1e-1+7e-2*j when p=1 then 1e-1+7e-2*(j-3) else 9e-1 end
       when ph=4 then 3e-1+1e-1*p+1e-2*j else 5e-1+8e-1*nx end gx0,
  case when ph=0 then 7e-1+2e-2*ny when ph=1 then 3e-1+4e-2*ny when ph=2 then 6e-1 when ph=3 then case when p<2 then 5e-1 else 1e-1*p end
       when ph=4 then 4e-1 else 5e-1+8e-1*ny end gy0,
  not (et='signup' and v>60) face_detected, not (et='view' and v>90) inout0 from c where not (et='error' and v>60))
select concat('v', lpad(cast(vid as varchar(10)),5,'0')) video_id, frame_pos, frame_pos*15 frame_idx, frame_pos*5e-1 ts, p person_id, face_detected,
 case when face_detected then fx-5e-2 end fx1, case when face_detected then fy-5e-2 end fy1, case when face_detected then fx+5e-2 end fx2, case when face_detected then fy+5e-2 end fy2,
 case when face_detected and not (ph=4 and j between 1 and 1+3*p) then gx0 end gx,
 case when face_detected and not (ph=4 and j between 1 and 1+3*p) then gy0 end gy,
 case when face_detected then inout0 end inout from d"""

GESTURES = """
select concat('v', lpad(cast(l_orderkey % 400 as varchar(10)),5,'0')) video_id,
  (l_orderkey*10 + l_linenumber)*1000000 + (l_partkey % 1000)*1000 + l_suppkey % 1000 gesture_key,
  case l_linenumber % 4 when 0 then 'pointing' when 1 then 'showing' when 2 then 'giving' else 'reaching' end gesture_type,
  (l_partkey % 230)/2e0 + (l_suppkey % 5)/1e1 start_time,
  (l_partkey % 230)/2e0 + (l_suppkey % 5)/1e1 + 5e-1 + (cast(l_quantity as bigint) % 8)/2e0 end_time,
  round(7e-1 + 3e0*cast(l_discount as double), 4) confidence, l_suppkey % 4 initiator_id,
  case when l_partkey % 2 = 0 then 'person' else 'object' end target_type,
  case when l_partkey % 2 = 0 then (l_suppkey + 1) % 4 end target_person_id
from (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount from {lineitem})"""

GAZE_EVENTS = """
select concat('v', lpad(cast(o_orderkey % 400 as varchar(10)),5,'0')) video_id, o_orderkey event_id,
  case o_orderkey % 5 when 0 then 'sudden_gaze_shift' when 1 then 'joint_attention' when 2 then 'gaze_following' when 3 then 'attention_capture' else 'mutual_gaze' end event_type,
  (o_custkey % 240)/2e0 start_time, (o_custkey % 240)/2e0 + case o_orderstatus when 'F' then 5e-1 when 'O' then 15e-1 else 0e0 end end_time,
  (60 + o_custkey % 41)/1e2 confidence, o_custkey % 4 person_a, (o_custkey + 1) % 4 person_b
from {orders}"""

GT_GESTURES = """
select concat('v', lpad(cast(o_orderkey % 400 as varchar(10)),5,'0')) video_id, o_orderkey gt_key,
  case o_orderkey % 4 when 0 then 'pointing' when 1 then 'showing' when 2 then 'giving' else 'reaching' end gesture_type,
  (o_custkey % 230)/2e0 start_time, (o_custkey % 230)/2e0 + 1e0 + (o_orderkey % 6)/2e0 end_time
from {orders}"""


def sql(text: str) -> str:
    """The text for an engine in which the tables are views."""
    return text.format(events="events", lineitem="lineitem", orders="orders", documents="documents")


def rows(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The text over the tables of a folder."""
    names = [n for n in ("events", "lineitem", "orders", "documents") if "{" + n + "}" in text]
    return spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})
