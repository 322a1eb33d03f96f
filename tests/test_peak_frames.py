"""The peak frame of a run of joint attention where frames converge alike."""

from sightline.operators import events


def test_first_of_equal_peaks(spark):
    """Convergence is summed up in any order, so equal frames differ in the last bits: the first of them has the centre, near
    which two persons look; near the second's centre nobody does."""
    frames = [("v", k, k * 15, k * 0.5, 0.8 + (k == 1) * 1.2e-16, 2, [0, 1], 0.5 if k == 0 else 0.9, 0.5) for k in range(3)]
    assert frames[1][4] > frames[0][4]
    f = spark.createDataFrame(frames, "video_id string, pos int, frame_idx long, ts double, convergence double, num_faces long, present array<long>, center_x double, center_y double")
    rows = [("v", k, p, True, 0.5, 0.5) for k in range(3) for p in (0, 1)]
    r = spark.createDataFrame(rows, "video_id string, pos int, person_id long, face boolean, x double, y double")
    found = events.joint_attention(r, f).collect()
    assert [(e.event_id, e.persons, e.details.center_x) for e in found] == [(1000, [0, 1], 0.5)]


def test_equal_means_are_ranked_by_time(spark):
    """Sums in another order change the last bits; other confidences are told apart by theirs."""
    rows = [(v, k, c, t, kind) for v, kind in (("v", "joint_attention"), ("w", "gaze_following")) for k, c, t in ((1, 0.8, 1.0), (2, 0.8 + 1.2e-16, 2.0), (3, 0.9, 3.0), (4, 0.7, 0.0))]
    df = spark.createDataFrame(rows, "video_id string, event_id long, confidence double, start_time double, event_type string")
    got = [(r.video_id, r.event_id) for r in events.candidates(df).orderBy("video_id", "rank").collect()]
    assert rows[1][2] > rows[0][2] and got == [("v", 3), ("v", 1), ("v", 2), ("w", 3), ("w", 2), ("w", 1)]
