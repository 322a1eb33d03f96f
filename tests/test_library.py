"""The library's queries beside their SQL, and rules beside plain loops."""

import random

import oracle
import pytest
from pyspark.sql import Row

from sightline.operators import evaluate, features, timeline
from sightline.operators.islands import sessionize
from sightline.plans import queries

FAST = ["w1_gap_fill", "a2_convergence", "e2_sudden_gaze_shift", "e3_joint_attention", "e4_gaze_following", "e5_attention_capture", "e6_mutual_gaze", "j4_cross_modal_pairs", "j5_temporal_relations", "t6_cap", "a8_threshold_cube", "a13_confusion", "w10_label_segments"]


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    n, why = oracle.compare(spark, oracle.duck(), queries.QUERIES[name], queries.ORACLE[name])
    assert not why
    assert n > 0


def gaze_rows(spec):
    """spec: (ts, gx or None) of one person with a face."""
    return [Row(video_id="v", frame_pos=i, frame_idx=i * 15, ts=float(t), person_id=1, face_detected=True, fx1=0.1, fy1=0.1, fx2=0.2, fy2=0.2, gx=x, gy=x, inout=None if x is None else True) for i, (t, x) in enumerate(spec)]


SCHEMA = "video_id string, frame_pos long, frame_idx long, ts double, person_id long, face_detected boolean, fx1 double, fy1 double, fx2 double, fy2 double, gx double, gy double, inout boolean"


def methods(spark, spec):
    rows = features.fill_gaps(features.observed(spark.createDataFrame(gaze_rows(spec), SCHEMA))).orderBy("obs_pos").collect()
    return [r.imethod for r in rows]


@pytest.mark.parametrize("n, step, want", [(1, 0.1, "linear_interpolation"), (3, 0.1, "linear_interpolation"), (4, 0.1, "carry_forward"), (10, 0.1, "carry_forward"), (11, 0.1, "null_gap_too_long"), (6, 0.5, "null_scene_cut")])
def test_gap_tiers(spark, n, step, want):
    spec = [(k * step, 0.5 if k in (0, n + 1) else None) for k in range(n + 2)]
    assert methods(spark, spec) == ["measured", *[want] * n, "measured"]


def test_edges_and_nothing_valid(spark):
    assert methods(spark, [(k * 0.1, 0.5 if k == 0 else None) for k in range(12)]) == ["measured", *["carry_forward"] * 10, "null_no_valid"]
    assert methods(spark, [(k * 0.1, 0.5 if k == 11 else None) for k in range(12)]) == ["null_no_valid", *["carry_backward"] * 10, "measured"]
    assert methods(spark, [(0.0, None)]) == ["null_no_valid"]


def test_gap_is_strict(spark):
    df = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 0.5), ("a", 2, 1.125), ("a", 3, 1.25)], "k string, n int, t double")
    assert [r.island for r in sessionize(df, ["k"], ["n"], "t", 0.625).orderBy("n").collect()] == [1, 1, 2, 2]


def test_greedy_match_equals_loop(spark):
    rng = random.Random(1)
    make = lambda n, key: [Row(**{"video_id": f"v{rng.randrange(4)}", key: i, "gesture_type": rng.choice(["pointing", "giving"]), "start_time": (s := rng.randrange(40) / 2), "end_time": s + rng.randrange(6) / 2}) for i in range(n)]
    gt, pred = make(60, "gt_key"), make(80, "gesture_key")
    used, want = set(), set()
    for p in sorted(pred, key=lambda r: (r.start_time, r.gesture_key)):
        for g in sorted(gt, key=lambda r: (r.start_time, r.gt_key)):
            if g.gt_key not in used and g.video_id == p.video_id and g.gesture_type == p.gesture_type and p.start_time <= g.end_time and g.start_time <= p.end_time:
                used.add(g.gt_key)
                want.add((p.gesture_key, g.gt_key))
                break
    got = evaluate.greedy_match(spark.createDataFrame(gt), spark.createDataFrame(pred))
    assert {(r.gesture_key, r.gt_key) for r in got.collect()} == want


def test_no_cross_product(spark):
    rows = spark.createDataFrame([("v", "gaze", 1, "x", 0.0, 1.0, 0.9, [1], 0), ("v", "gesture", 2, "y", 2.0, 3.0, 0.9, [1], 1)], "video_id string, source string, item long, kind string, start_time double, end_time double, confidence double, persons array<long>, place int")
    pairs = timeline.cross_modal_pairs(rows)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert [(r.relation, r.seconds) for r in pairs.collect()] == [("adjacent", 1.0)]
