"""Whole jobs: streams that are stopped, chains that are resumed, sinks written twice, files of every kind, and greedy jobs
beside plain loops."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from sightline.operators import evaluate, graph, timeline
from sightline.plans import jobs
from sightline.plans import timeline as plans
from sightline.plans.chain import gaze_chain
from sightline.plans.gaze import gaze
from sightline.sources import documents, pairing, sinks

SF = "/root/testdata/sf0.001"


def put(folder, name, value):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value, indent=2))


def event_document(n):
    return {"num_events": n, "event_counts": {"mutual_gaze": n}, "events": [{"event_id": k, "event_type": "mutual_gaze", "start_time": 1.0, "end_time": 2.5, "start_frame": 30, "end_frame": 75, "confidence": 0.9, "persons_involved": [0, 1]} for k in range(n)]}


def test_ingest_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    inbox, table = tmp_path / "in", str(tmp_path / "table")
    for k in range(6):
        put(inbox / f"set{k % 2}", f"v{k}_gaze_events.json", event_document(k + 1))
    put(inbox / "set0", "broken_events.json", '{"num_events": 1, "events": [')
    put(inbox / "set1", "other.json", {"something": "else"})
    put(inbox / "set1", "v0_features.json", event_document(9))
    args = (spark, str(inbox), documents.EVENTS, table, ["set0", "set1"])
    # a document derived from events is skipped; here events themselves are asked for, so only features are derived
    monkeypatch.setattr(documents, "DERIVED", ["_features.json"])
    # the run dies in its second batch, after the documents are written and before the bad ones are
    calls, write = [], sinks.DataFrameWriter.parquet

    def dies(self, path, *a, **k):
        calls.append(path)
        if len(calls) == 4:
            raise RuntimeError("lost")
        return write(self, path, *a, **k)

    monkeypatch.setattr(sinks.DataFrameWriter, "parquet", dies)
    with pytest.raises(Exception, match="lost"):
        sinks.ingest(*args, files=3).awaitTermination()
    monkeypatch.setattr(sinks.DataFrameWriter, "parquet", write)
    sinks.ingest(*args, files=3).awaitTermination()
    found = sinks.taken(spark, table).select("dataset", "video_id", "num_events").collect()
    assert sorted(map(tuple, found)) == [(f"set{k % 2}", f"v{k}", k + 1) for k in sorted(range(6), key=lambda k: (k % 2, k))]
    assert {(r.dataset, r.documents, r.bad) for r in sinks.ingest_outcome(spark, table).collect()} == {("set0", 3, 1), ("set1", 3, 1)}
    # only what is new is read, and a video that is known is left as it is
    put(inbox / "set0", "v6_events.json", event_document(7))
    put(inbox / "set0", "v0_sam3rf_gaze_events.json", event_document(50))
    query = sinks.ingest(*args)
    query.awaitTermination()
    assert sum(p["numInputRows"] for p in query.recentProgress) == 2
    assert {r.video_id: r.num_events for r in sinks.taken(spark, table).collect()} == {f"v{k}": k + 1 for k in range(7)}
    again = sinks.ingest(*args)
    again.awaitTermination()
    assert sum(p["numInputRows"] for p in again.recentProgress) == 0 and sinks.taken(spark, table).count() == 7


def test_ingest_of_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    sinks.ingest(spark, str(tmp_path / "in"), documents.EVENTS, str(tmp_path / "t"), ["a"]).awaitTermination()
    assert sinks.taken(spark, str(tmp_path / "t")) is None
    assert sinks.ingest_outcome(spark, str(tmp_path / "t")).collect() == []


def test_sink_replaces_its_folders_only(spark, tmp_path, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these files are small
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    rows = spark.range(1000).select("id", F.when(F.col("id") < 900, "hot").when(F.col("id") < 990, "b").alias("dataset"))
    path = str(tmp_path / "t")
    sinks.save_by(rows, path, ["dataset"], ["id"], rows_a_file=100)
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "t").iterdir() if p.is_dir()}
    assert 3 <= files["dataset=hot"] <= 9 and files["dataset=b"] == 1 and len(files) == 3
    before = sorted(p.name for p in (tmp_path / "t" / "dataset=hot").glob("*.parquet"))
    sinks.save_by(rows.where("dataset = 'b' AND id % 2 = 0"), path, ["dataset"], ["id"], rows_a_file=100)
    assert sorted(p.name for p in (tmp_path / "t" / "dataset=hot").glob("*.parquet")) == before
    assert {r.dataset: r.n for r in spark.read.parquet(path).groupBy("dataset").agg(F.count("*").alias("n")).collect()} == {"hot": 900, "b": 45, None: 10}


def test_chain_makes_only_what_is_missing(spark, tmp_path):
    rows = gaze(spark, SF)
    chain = gaze_chain(spark, str(tmp_path / "c"))
    some = rows.where("video_id IN ('v00000', 'v00001')")
    stages = ["features", "frames", "events", "candidates", "counts"]
    assert chain.run(some) == dict.fromkeys(stages, 2)
    n = rows.select("video_id").distinct().count()
    assert chain.run(rows) == dict.fromkeys(stages, n - 2)
    assert chain.run(rows) == dict.fromkeys(stages, 0)
    want = {r.video_id: r for r in chain.rows("counts").collect()}
    assert len(want) == n and all(r.events >= r.candidates for r in want.values())
    # what a run wrote before it died isn't read
    chain.rows("events").withColumn("run", F.lit("lost")).write.mode("append").partitionBy("run").parquet(f"{chain.root}/events/rows")
    assert chain.rows("events").count() == sum(r.events for r in want.values())
    # a stage that is taken away is made again, from the results before it
    (tmp_path / "c/events/rows").rename(tmp_path / "gone")
    (tmp_path / "c/events/manifest").rename(tmp_path / "gone manifest")
    assert chain.run(rows) == dict.fromkeys(stages, 0) | {"events": n}
    (tmp_path / "c/counts/manifest").rename(tmp_path / "gone counts")
    assert chain.run(rows)["counts"] == n
    assert {r.video_id: r for r in chain.rows("counts").collect()} == want


def test_files_of_every_kind(spark, tmp_path):
    person = {"person_id": 3, "face_detected": True, "face_bbox": [0.1, 0.2, 0.3, 0.4], "gaze_point": [0.5, 0.6], "inout": True}
    put(tmp_path / "a", "clip_1_sam3rf_gaze.json", {"video_fps": 30.0, "sample_fps": 2.0, "persons_summary": {"3": {"first_frame": 0, "last_frame": 15, "track_length": 2, "face_detection_pct": 50.0, "inframe_gaze_pct": 50.0}}, "frames": [{"frame_idx": 0, "timestamp": 0.0, "persons": [person]}, {"frame_idx": 15, "timestamp": 0.5, "persons": [{"person_id": 3, "face_detected": False}]}]})
    put(tmp_path / "a", "clip_1_gaze_events.json", event_document(2))
    put(tmp_path / "a", "clip_2_sam3rf_gaze.json", "{ cut off")
    put(tmp_path / "a", "notes.json", {"hello": 1})
    docs = documents.read(spark, str(tmp_path / "a"), documents.SAMPLES)
    assert {(r.video_id, r.bad) for r in docs.collect()} == {("clip_1", False), ("clip_2", True), ("notes", True)}
    assert documents.outcome(docs).first().asDict() == {"documents": 1, "bad": 2}
    assert [(r.video_id, r.frame_pos, r.person_id, r.face_detected, r.gx, r.inout) for r in documents.samples(docs).orderBy("frame_pos").collect()] == [("clip_1", 0, 3, True, 0.5, True), ("clip_1", 1, 3, False, None, None)]
    derived = documents.read(spark, str(tmp_path / "a"), documents.EVENTS, "*_events.json", derived=True)
    assert documents.elements(derived, "events").count() == 2 and derived.first().video_id == "clip_1"

    put(tmp_path / "gt", "big clip.mp4.json", {"gestures": [{"gesture_type": "giving", "start_time": 3, "end_time": "1:02.5", "initiator_id": 0}, {"start_time": "soon", "confidence": 0.4}]})
    truth = documents.ground_truth(documents.read(spark, str(tmp_path / "gt"), documents.GESTURES, "*.mp4.json")).orderBy("gt_key").collect()
    told = [(r.gt_video, r.gt_key, r.gesture_type, r.start_time, r.end_time, r.initiator_id, r.target_type, r.target_description, r.confidence) for r in truth]
    assert told == [("big clip", 0, "giving", 3.0, 62.5, 0, "unknown", "", 1.0), ("big clip", 1, "unknown", 0.0, 0.0, -1, "unknown", "", 0.4)]

    put(tmp_path / "labels", "NewAnt_7_1.txt", "0 10 20 60 90 15 0 0 0 Person1 na Mutual P2\n 1 10 20 60 90 x 0 0 0 Person1 na mutual P2\nshort line\n2 1 1 1 1 18 0 0 0 Object1 na mutual P2\n3 1 1 1 1 18 0 0 0 Person2 na dancing P2\n")
    assert [tuple(r) for r in documents.gaze_labels(spark, str(tmp_path / "labels"), ["mutual", "share"]).collect()] == [("7_1", 15, "Person1", "mutual")]

    put(tmp_path / "srt", "episode_2.srt", "1\r\n00:00:01,500 --> 00:00:03,000\r\n<i>Hello</i>\r\nthere\r\n\r\n2\n00:01:00.250 --> 00:01:02.000\n\n\n3\nno time\nhere\n")
    assert [(r.start_time, r.end_time, r.text) for r in documents.read_subtitles(spark, str(tmp_path / "srt")).collect()] == [(1.5, 3.0, "Hello there")]

    put(tmp_path / "chunks", "chunk_0.json", {"tracks": {"5": [{"person_id": 1, "bbox": [0.0, 0.1, 0.2, 0.3], "score": 0.9}], "6": []}, "num_frames": 2})
    boxes = documents.tracks(documents.read(spark, str(tmp_path / "chunks"), documents.TRACKS)).collect()
    assert [tuple(r) for r in boxes] == [("chunk_0", 5, 1, 0.0, 0.1, 0.2, 0.3, 0.9)]

    put(tmp_path / "tv", "qa.json", [{"qid": 7, "vid_name": "s01e02_seg02_clip_12", "ts": [1.0, 2.0], "q": "Who?", **{f"a{k}": "x" for k in range(5)}, "answer_idx": 1, "bbox": {"14": [{"label": "Ann", "left": 1, "top": 2, "width": 3, "height": 4}]}}, {"qid": 8, "q": "none"}])
    entries = documents.tv_questions(spark, str(tmp_path / "tv"))
    assert entries.count() == 2 and [tuple(r) for r in documents.tv_boxes(entries).collect()] == [(7, 14, 0, "Ann", 1.0, 2.0, 4.0, 6.0)]

    put(tmp_path / "p", "one.json", {"video_path": "x", "video_fps": 30.0, "video_size": [640, 480], "total_frames": 1, "processed_frames": 1, "sample_fps": 2.0, "text_prompt": None, "frames": [{"frame_idx": 0, "timestamp": 0.0, "gaze_point": [0.25, 0.5], "gaze_point_px": [160, 240], "inout": 0.5, "head_bbox": [0, 0, 1, 1], "head_bbox_px": [0, 0, 640, 480]}]})
    assert [(r.gx, r.gy, r.in_frame) for r in documents.predictions(documents.read(spark, str(tmp_path / "p"), documents.PREDICTIONS)).collect()] == [(0.25, 0.5, False)]

    documents.export(spark.createDataFrame([("a", 1), ("b", 2)], "video_id string, num_events long"), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["video=a", "video=b"]
    counts = spark.createDataFrame([("b.json", 2), ("a.json", 1)], "filename string, person_count int")
    done = documents.not_done(spark.createDataFrame([("a",), ("b",)], "video_id string"), spark.createDataFrame([("a",)], "video_id string"))
    assert [r.video_id for r in done.collect()] == ["b"] and counts.count() == 2


def test_pairs_of_real_files(spark, tmp_path):
    for name in ("x_viz.mp4", "y_sam3rf_viz.mp4", "z_viz.mp4", "other.mp4"):
        put(tmp_path / "v", name, "frames")
    for name in ("x_gaze_events.json", "x_events.json", "y_sam3rf_gaze_events.json"):
        put(tmp_path / "e", name, "{}")
    for name in ("x_viz_gestures_v2.json", "y_gestures_v2.json", "y_sam3rf_viz_gestures_v2.json"):
        put(tmp_path / "g", name, "{}")
    rendered, events, gestures = (pairing.listing(spark, str(tmp_path / k)) for k in "veg")
    got = {pairing_name(r.path): (pairing_name(r.events_path), pairing_name(r.gestures_path)) for r in pairing.paired_files(rendered, events, gestures).collect()}
    assert got == {"x_viz.mp4": ("x_events.json", "x_viz_gestures_v2.json"), "y_sam3rf_viz.mp4": ("y_sam3rf_gaze_events.json", "y_gestures_v2.json"), "z_viz.mp4": (None, None)}
    assert "content" not in rendered._jdf.queryExecution().executedPlan().toString()


def pairing_name(path):
    return path and path.rsplit("/", 1)[1]


def test_cross_graph_pairs_after_the_filter(spark):
    rows = plans.merged(spark, SF)
    nodes, pairs, told = graph.cross_graph(rows)
    by = {}
    for r in nodes.collect():
        by.setdefault(r.video_id, []).append(r)
    want = set()
    for v, events in by.items():
        assert sorted(r.place for r in events) == list(range(len(events)))
        for a in events:
            for b in events:
                if a.source == "gaze" and b.source == "gesture":
                    over = a.start_time < b.end_time and b.start_time < a.end_time
                    apart = max(a.start_time, b.start_time) - min(a.end_time, b.end_time)
                    if over or apart <= 3:
                        want.add((v, a.place, b.place, "overlap" if over else "adjacent"))
    assert {(r.video_id, r.gaze_place, r.gesture_place, r.relation) for r in pairs.collect()} == want and want
    for r in told.collect():
        assert r.filtered == len(by[r.video_id]) == r.gaze + r.gesture and r.pairs == sum(w[0] == r.video_id for w in want)


def loop_match(pred, truth):
    """Places of truth taken by each prediction in order."""
    used, out = set(), {}
    for k, p in enumerate(pred):
        for j, g in enumerate(truth):
            if j not in used and g[0] == p[0] and not (p[2] < g[1] or g[2] < p[1]):
                used.add(j)
                out[k] = j
                break
    return out


def test_merge_and_evaluation_of_segments(spark):
    gaze_rows, hands, lengths, truth = jobs._segments(spark, SF)
    known = {r.video_id: r.seconds for r in lengths.collect()}
    preds, seen = {}, {}
    for r in hands.orderBy("video_id", "gesture_key").collect():
        preds.setdefault(r.video_id, []).append(r)
    for r in gaze_rows.collect():
        seen.setdefault(r.video_id, []).append(r)
    gts = {}
    for r in truth.orderBy("gt_video", "gt_key").collect():
        gts.setdefault(r.gt_video, []).append((r.gesture_type, r.start_time, r.end_time))
    parts = {}
    for v in sorted(set(preds) | set(seen)):
        name, n = re.match(r"(.+)_(\d{3})$", v).groups()
        parts.setdefault(name, []).append((int(n), v))
    offsets = {}
    for segments in parts.values():
        at = 0.0
        for _, v in sorted(segments):
            offsets[v] = at
            at += known.get(v, 120.0)
    want = {}
    for v in offsets:
        rows = [(r.gesture_type, float(int(r.start_time * 2)) / 2, (r.end_time * 2 // 1 + (r.end_time * 2 % 1 > 0)) / 2, r.confidence) for r in preds.get(v, []) if r.confidence >= 0.85]
        rows = [r for r in rows if r[2] <= known.get(v, 120.0)]
        own = gts.get(v.rsplit("_", 1)[0].replace("_", " "))
        kept, before, choice = len(rows), None, None
        if own is not None:
            before = len(rows)
            found = loop_match([(k, a + offsets[v], z + offsets[v]) for k, a, z, _ in rows], own)
            kept = len(found) or min(3, len(rows))
            choice = "gt_match" if found else "fallback_sample" if rows else "no_gestures"
        n = sum(r.confidence >= 0.9 for r in seen.get(v, []))
        want[v] = (n, kept, n + kept, before, choice)
    rows, told = graph.merge_job(gaze_rows, hands, lengths, truth)
    assert {r.video_id: (r.gaze_events, r.gestures, r.total, r.before_truth, r.choice) for r in told.collect()} == want
    assert {c for *_, c in want.values()} >= {"gt_match", None} and rows.count() == sum(x[2] for x in want.values())

    # evaluation: predictions of a video in order of segment and key, on the clock of the segments that have gestures
    tp, fp, fn = {}, {}, {}
    for name, segments in parts.items():
        own = gts.get(name.replace("_", " "))
        at, pred = 0.0, []
        for _, v in sorted(segments):
            if v in preds:
                pred += [(r.gesture_type, r.start_time + at, r.end_time + at) for r in preds[v] if r.confidence >= 0.75]
                at += known.get(v, 120.0)
        if own is None:
            continue
        found = loop_match(pred, own)
        for k in {p[0] for p in pred} | {g[0] for g in own}:
            t = sum(pred[i][0] == k for i in found)
            tp[k], fp[k], fn[k] = tp.get(k, 0) + t, fp.get(k, 0) + sum(p[0] == k for p in pred) - t, fn.get(k, 0) + sum(g[0] == k for g in own) - t
    whole, cells, by_part = graph.evaluate_job(hands, lengths, truth, 0.75)
    got = {r.gesture_type: (r.tp, r.fp, r.fn) for r in whole.collect()}
    assert got.pop(None) == (sum(tp.values()), sum(fp.values()), sum(fn.values()))
    assert got == {k: (tp[k], fp[k], fn[k]) for k in tp} and sum(tp.values()) > 0
    matrix = evaluate.confusion_matrix(cells, ["pointing", "showing", "giving", "reaching"]).collect()
    assert sum(sum(r[k] for k in ("pointing", "showing", "giving", "reaching", "missed")) for r in matrix if r.gt_type) == sum(tp.values()) + sum(fn.values())
    assert by_part.count() > 0


def test_replies_that_are_no_json(spark):
    df = spark.createDataFrame([("v", '{"1": "a", "2": ""}'), ("w", 'well {"1": "b {x}"} so'), ("x", "nothing"), ("y", None)], "video_id string, reply string")
    events = spark.createDataFrame([(v, k) for v in "vwxyz" for k in (1, 2)], "video_id string, item long")
    assert {(r.video_id, r.item): r.description for r in graph.describe(events, df, "item").collect() if r.description} == {("v", 1): "a", ("w", 1): "b {x}"}


def test_islands_are_small(spark):
    """A video whose gestures never pause is cut where its intervals don't hang together."""
    rows = spark.createDataFrame([("v", "pointing", k, 2.0 * k, 2.0 * k + 1.0) for k in range(500)], "video_id string, gesture_type string, gesture_key long, start_time double, end_time double")
    truth = rows.withColumnRenamed("gesture_key", "gt_key").withColumns({"start_time": F.col("start_time") + 0.5, "end_time": F.col("end_time") + 0.5})
    runs = evaluate.in_islands(truth, rows, ["video_id", "gesture_type"])
    assert runs.select("_island").distinct().count() == 500
    assert evaluate.greedy_match(truth, rows).where("gesture_key = gt_key").count() == 500
    plan = timeline.drop_doubles(plans.merged(spark, SF), plans.merged(spark, SF).limit(1))._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan
