"""The face tracker beside a plain loop, and streams that keep a state beside their batch forms."""

import math
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from sightline.operators import questions, tracks
from sightline.streaming import sessions, state

DETECTIONS = "video_id string, frame long, det_id long, x1 double, y1 double, x2 double, y2 double, embedding array<double>"
A, B, C = [1.0, 0.0, 0.1], [0.0, 1.0, 0.1], [0.5, 0.5, 0.9]


def box(x, y=0.0, size=1.0):
    return (x, y, x + size, y + size)


def detections():
    """Two faces that move and swap places, one without embeddings, one that comes back after a gap, and a repeated box."""
    rows = []
    for f in range(8):
        rows += [("v", f, 0, *box(0.5 * f), A), ("v", f, 1, *box(3.5 - 0.5 * f, 0.2), B if f != 3 else None)]
    rows += [("v", 2, 2, *box(20.0), C), ("v", 12, 0, *box(30.0), C), ("v", 12, 1, *box(9.0), A), ("v", 13, 0, *box(9.0), None), ("v", 13, 1, *box(9.2), None), ("v", 14, 0, *box(9.0), A), ("v", 14, 1, *box(9.2), A), ("w", 5, 0, *box(0.0), None)]
    return rows


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return w * h / (area(a) + area(b) - w * h)


def dist(a, b):
    if a is None or b is None:
        return 1.0
    return 1 - sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) + 1e-8) / (math.hypot(*b) + 1e-8)


def by_hand(rows, patience):
    """Counts frame by frame, empty frames included; the cheapest assignment by trying all."""
    out = {}
    for v in {r[0] for r in rows}:
        live, gone, fresh = {}, {}, 0
        for f in range(max(r[1] for r in rows) + 1):
            for t in live.values():
                t["unseen"] += 1
            now = sorted((r for r in rows if r[0] == v and r[1] == f), key=lambda r: r[2])
            ids, taken = sorted(live), {}
            if ids and now:

                def cost(i, j, now=now, live=live):
                    t, r = live[i], now[j]
                    c = 1 - iou(t["box"], r[3:7])
                    return c if t["look"] is None or r[7] is None else 0.6 * c + 0.4 * dist(t["look"], r[7])

                n = len(now)
                if len(ids) >= n:
                    best = min(permutations(ids, n), key=lambda p: sum(cost(i, j) for j, i in enumerate(p)))
                    pairs = [(i, j) for j, i in enumerate(best)]
                else:
                    best = min(permutations(range(n), len(ids)), key=lambda p: sum(cost(i, j) for i, j in zip(ids, p)))
                    pairs = list(zip(ids, best))
                for i, j in pairs:
                    t, r = live[i], now[j]
                    if iou(t["box"], r[3:7]) >= 0.3 or (r[7] is not None and dist(t["look"], r[7]) < 0.7):
                        look = t["look"] if r[7] is None else r[7] if t["look"] is None else [0.7 * x + 0.3 * y for x, y in zip(t["look"], r[7])]
                        live[i] = {"box": r[3:7], "look": look, "unseen": 0}
                        taken[j] = i
            for j, r in enumerate(now):
                if j not in taken:
                    near = sorted((dist(r[7], e), k) for k, e in gone.items()) if r[7] is not None else []
                    if near and near[0][0] < 0.7:
                        k = near[0][1]
                        del gone[k]
                    else:
                        k, fresh = fresh, fresh + 1
                    live[k] = {"box": r[3:7], "look": r[7], "unseen": 0}
                    taken[j] = k
                out[v, f, r[2]] = taken[j]
            for k in [k for k, t in live.items() if t["unseen"] > patience]:
                t = live.pop(k)
                if t["look"] is not None:
                    gone[k] = t["look"]
    return out


def as_dict(df):
    return {(r.video_id, r.frame, r.det_id): r.face_id for r in df}


@pytest.mark.parametrize("patience", [0, 2, 999_999])
def test_faces_as_by_hand(spark, patience):
    rows = detections()
    got = as_dict(tracks.track_faces(spark.createDataFrame(rows, DETECTIONS), patience).collect())
    assert got == by_hand(rows, patience)
    assert len({got["v", f, 0] for f in range(8)}) == 1 or patience == 0


def test_no_faces(spark):
    assert tracks.track_faces(spark.createDataFrame([], DETECTIONS)).count() == 0


def run(spark, tmp_path, name, parts, f):
    """Each part is a run of its own, which goes on from the checkpoint of the one before."""
    path = str(tmp_path / name)
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
        out = f(spark.readStream.schema(part.schema).parquet(path)).writeStream.format("parquet").option("path", str(tmp_path / f"out_{name}"))
        q = out.option("checkpointLocation", str(tmp_path / f"c_{name}")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(180)
    return q


def test_faces_on_a_stream(spark, tmp_path):
    rows = detections()
    parts = [spark.createDataFrame([r for r in rows if lo <= r[1] < hi], DETECTIONS) for lo, hi in ((0, 4), (4, 99))]
    run(spark, tmp_path, "faces", parts, lambda s: state.track_faces(s, 2, None))
    assert as_dict(spark.read.parquet(str(tmp_path / "out_faces")).collect()) == by_hand(rows, 2)


def test_faces_that_come_back_on_a_stream(spark, tmp_path):
    """A run for each frame, so that all that is known goes through the state store, faces that are gone included."""
    rows = [r for r in detections() if r[0] == "v"]
    cuts = [0, 1, 3, 4, 12, 13, 14, 99]
    parts = [spark.createDataFrame([r for r in rows if lo <= r[1] < hi], DETECTIONS) for lo, hi in zip(cuts, cuts[1:])]
    run(spark, tmp_path, "back", parts, lambda s: state.track_faces(s, 0, None))
    assert as_dict(spark.read.parquet(str(tmp_path / "out_back")).collect()) == by_hand(rows, 0)


def test_gaze_is_carried_forward(spark, tmp_path):
    seen = {0, 1, 14}
    rows = [("v", 1, 0.25 * k, 0.1 * k if k in seen else None, 0.5 if k in seen else None, True if k in seen else None) for k in range(15)] + [("v", 2, 9.0, 0.3, 0.3, False)]
    schema = "video_id string, person_id long, ts double, gx double, gy double, inout boolean"
    run(spark, tmp_path, "gaze", [spark.createDataFrame(p, schema) for p in (rows[:5], rows[5:])], lambda s: state.carry_forward(s, idle_millis=None))
    got = {(r.person_id, r.ts): r for r in spark.read.parquet(str(tmp_path / "out_gaze")).collect()}
    for k in range(15):
        r = got[1, 0.25 * k]
        if k in seen:
            assert (r.x, r.method, r.confidence) == (0.1 * k, "measured", 1.0)
        elif k - 1 <= 10:
            assert (r.x, r.method) == (0.1, "carry_forward") and r.confidence == pytest.approx(0.5 * math.exp(-0.2 * (k - 1)))
        else:  # eleven rows, or over 3 seconds
            assert r.x is None and r.method == ("null_scene_cut" if 0.25 * (k - 1) > 3 else "null_no_valid") and r.confidence == 0
    assert got[2, 9.0].method == "null_no_valid"


def test_late_rows_are_counted(spark, tmp_path, request):
    """Over more batches than a query's own recent progress keeps."""
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates"))
    late = state.LateRows()
    spark.streams.addListener(late)
    request.addfinalizer(lambda: spark.streams.removeListener(late))
    path = str(tmp_path / "late")
    schema = "video_id string, gesture_type string, ts timestamp"
    seconds = [[0, 1000], *([k % 3, 1000 + k] for k in range(1, 12))]  # each batch after the first has a late row
    for part in seconds:
        rows = spark.createDataFrame([("v", "pointing", float(s)) for s in part], "video_id string, gesture_type string, s double")
        rows.select("video_id", "gesture_type", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts")).coalesce(1).write.mode("append").parquet(path)
    stream = sessions.tumbling_counts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    q = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert len(q.recentProgress) <= 3 and late.of(q) == 10  # a batch is judged by the watermark before the last one


def test_prompts_by_density(spark):
    e = "video_id string, source string, event_type string, target_type string, target_person_id long"
    gaze = lambda v, kind="mutual_gaze": (v, "gaze", kind, None, None)
    gesture = lambda v, who=None: (v, "gesture", "pointing", "person", who)
    rows = [gaze("a"), gaze("a"), *[gaze("b")] * 3, *[gaze("c")] * 2, gaze("c", "joint_attention"), *[gesture("d")] * 3, *[gesture("e", 1)] * 2, *[gesture("e")] * 2, gaze("f"), gesture("f"), (None, "gaze", None, None, None), ("g", None, None, None, None)]
    got = {}
    for r in questions.prompt_routes(spark.createDataFrame(rows, e), spark.createDataFrame([("f",), ("f",), ("a",)], "video_id string")).collect():
        got.setdefault(r.video_id, set()).add(r.prompt[7:])
    assert got == {"a": {"A"}, "b": {"B"}, "c": {"B", "B_OE"}, "d": {"C"}, "e": {"D", "D_OE"}, "f": {"A", "C", "E", "E_OE"}, None: {"A"}}


def test_event_texts_of_odd_rows(spark):
    rows = [("nod", 1.005, None, [1, 2]), (None, 0.0, 2.5, None), ("mutual_gaze", 1.0, 2.0, [])]
    got = [r.text for r in questions.event_texts(spark.createDataFrame(rows, "event_type string, start_time double, end_time double, persons array<long>")).collect()]
    assert got[0].startswith("Type: nod = nod; time: 1.0") and got[0].endswith("s - 0.00s; persons: P1, P2")
    assert got[1:] == ["Type: unknown = unknown; time: 0.00s - 2.50s; persons: ", "Type: mutual_gaze = Two people looking at each other; time: 1.00s - 2.00s; persons: "]
