"""Greedy rules, written texts and clips beside plain loops."""

import re
from collections import Counter

import __spark_entry__ as entry
from sightline.operators import evaluate, questions, reports
from sightline.plans import evaluation
from sightline.plans import questions as asked
from sightline.plans import timeline as plans

SF = "/root/testdata/sf0.001"


def query(spark, name):
    return entry.queries()[name](spark, SF).collect()


def by_video(rows):
    out = {}
    for r in rows:
        out.setdefault(r.video_id, []).append(r)
    return out


def test_keep_matched(spark):
    g, t = by_video(plans.gestures(spark, SF).collect()), by_video(plans.gt(spark, SF).collect())
    want = set()
    for video, rows in g.items():
        used, found = set(), []
        for p in sorted(rows, key=lambda r: (r.start_time, r.gesture_key)):
            for x in sorted(t.get(video, []), key=lambda r: (r.start_time, r.gt_key)):
                if x.gt_key not in used and x.gesture_type == p.gesture_type and not (p.end_time < x.start_time or x.end_time < p.start_time):
                    used.add(x.gt_key)
                    found.append(p)
                    break
        if found:
            want |= {(video, p.gesture_key, "gt_match") for p in found}
            continue
        order = lambda r: (-r.confidence, r.start_time, r.gesture_key)
        best = sorted((min((r for r in rows if r.gesture_type == k), key=order) for k in {r.gesture_type for r in rows}), key=order)
        rest = sorted((r for r in rows if r not in best), key=order)
        want |= {(video, p.gesture_key, "fallback_sample") for p in (best + rest)[:3]}
    got = {(r.video_id, r.gesture_key, r.choice) for r in query(spark, "j13_keep_matched")}
    assert got == want and {c for *_, c in got} == {"gt_match", "fallback_sample"}


def test_gaze_evaluation(spark):
    g, p = evaluation._gaze_sides(spark, SF)
    p = p.withColumn("start_frame", p.start_frame * 2).withColumn("end_frame", p.end_frame * 2 + 3)
    gt, pred = by_video(g.collect()), by_video(p.collect())
    want = {}
    for video, rows in gt.items():
        used = set()
        for x in sorted(rows, key=lambda r: r.gt_no):
            best = None
            for e in sorted(pred.get(video, []), key=lambda r: r.event_id):
                if e.event_id in used or e.event_type not in evaluate.STANDS_FOR.get(x.kind, []):
                    continue
                both = max(0, min(x.end_frame, e.end_frame) - max(x.start_frame, e.start_frame) + 1)
                iou = both / (x.end_frame - x.start_frame + 1 + e.end_frame - e.start_frame + 1 - both)
                if iou >= 0.1 and (best is None or iou > best[0]):
                    best = iou, e.event_id
            if best:
                used.add(best[1])
                want[video, x.gt_no] = best[1], round(best[0], 9)
    found = evaluate.match_gaze(g, p, 0.1)
    assert {(r.video_id, r.gt_no): (r.event_id, round(r.iou, 9)) for r in found.collect()} == want and want
    rows = {r.video_id: r for r in evaluate.gaze_scores(g, p, found).collect()}
    assert rows[None].matched == len(want) and set(rows) - {None} == set(gt) & set(pred)
    for v, r in rows.items():
        if v:
            assert r.gt_segments == sum(x.kind in evaluate.STANDS_FOR for x in gt[v]) and abs(r.recall - (r.matched / r.gt_segments if r.gt_segments else 0)) < 1e-9


def test_scores_by_part(spark):
    """Predictions in order of time take the first free truth of their kind and part."""
    located = lambda rows: [r for r in evaluation._located(spark, SF, rows).collect() if r.part]
    gts, preds = located(plans.gt(spark, SF)), located(plans.gestures(spark, SF))
    used, tp, seconds = set(), {}, {}
    for p in sorted(preds, key=lambda r: (r.start_time, r.gesture_key)):
        for g in sorted((g for g in gts if g.video_id == p.video_id), key=lambda r: (r.start_time, r.gt_key)):
            if g.gt_key not in used and (g.part, g.gesture_type) == (p.part, p.gesture_type) and p.start_time <= g.end_time and g.start_time <= p.end_time:
                used.add(g.gt_key)
                k = p.part, p.gesture_type
                tp[k] = tp.get(k, 0) + 1
                seconds[k] = seconds.get(k, 0) + min(p.end_time, g.end_time) - max(p.start_time, g.start_time)
                break
    got = {(r.part, r.gesture_type): r for r in query(spark, "a12_scores_by_part")}
    count = lambda rows: Counter((r.part, r.gesture_type) for r in rows)
    g, p = count(gts), count(preds)
    assert set(got) == set(g) | set(p) and tp
    for k, r in got.items():
        n = tp.get(k, 0)
        assert (r.tp, r.fp, r.fn) == (n, p[k] - n, g[k] - n) and abs(r.mean_overlap - (seconds[k] / n if n else 0)) < 1e-9


def test_sample_of_videos(spark):
    rows = spark.createDataFrame([(f"v{k}",) for k in range(50)], "video_id string")
    pick = lambda d, **k: [r.video_id for r in reports.sample_videos(d, **k).collect()]
    some = pick(rows, n=7)
    assert len(set(some)) == 7 and some == pick(rows.repartition(5), n=7) and some == pick(rows, n=12)[:7]
    assert pick(rows, ratio=0.14) == some and len(pick(rows, ratio=0.001)) == 1 and pick(rows, n=7, seed=1) != some
    assert len(pick(rows, n=99)) == 50


def test_drop_alike(spark):
    rows = by_video(questions.checked(asked._written(spark, "/root/testdata/sf0.01")).where("reason IS NULL").collect())
    want = set()
    for video, qs in rows.items():
        seen = {}
        for q in sorted(qs, key=lambda r: r.idx):
            words = set(q.question.lower().split())
            if all(len(words & s) / len(words | s) <= 0.6 for s in seen.setdefault(q.mode, [])):
                seen[q.mode].append(words)
                want.add((video, q.idx))
    got = {(r.video_id, r.idx) for r in entry.queries()["e12_ingest_replies"](spark, "/root/testdata/sf0.01").collect()}
    assert got == want and got


def shifted(text, offset):
    def one(m):
        v = max(0.0, round(float(m[1]) - offset, 1))
        return f"{v:.1f}"

    return re.sub(r"(?<![A-Za-z])(\d+\.\d+)(?=\s*(?:s(?:econds?)?|,|\s|and\s|$|\?))", one, text)


def test_clip_questions(spark):
    texts = ["At 12.5s and 13.0 seconds, x1.5s? ends 7.25, 9.85 s, 12.35 and 30.75", "how long from 3.5 s", None]
    options = [[f"A) from {k}.5 seconds", "B) 4.0 s", " C) none", "D) 9.5"] for k in (3, 8, 5)]
    rows = [("v", k, f, q, "b", "old 6.5s", o, [10.0, 11.5], 60.0) for k, (q, o, f) in enumerate(zip(texts, options, ("mcq", "mcq", "open_ended")))]
    rows += [("v", 7, "mcq", "no range", "A", "", options[0], [], 60.0), ("v", 8, "mcq", "beyond", "A", "", options[0], [90.0, 91.0], 20.0)]
    df = spark.createDataFrame(rows, "video_id string, idx int, format string, question string, answer string, answer_text string, options array<string>, time_range array<double>, length double")
    got = {r.clip_name: r for r in questions.clip_questions(df).collect()}
    assert set(got) == {"v_qa0000", "v_qa0001", "v_qa0002"}
    for k, (q, o) in enumerate(zip(texts, options)):
        r = got[f"v_qa000{k}"]
        assert 7.0 <= r.clip_offset <= 9.0 and r.clip_offset * 2 % 1 == 0 and 3.5 <= r.clip_duration <= 7.5
        assert r.question == (q and shifted(q, r.clip_offset))
        want = o if k == 1 else [shifted(x, r.clip_offset) for x in o]
        assert r.options == want and r.time_range == [10.0 - r.clip_offset, 11.5 - r.clip_offset]
        assert r.answer_text == (want[1][3:] if k < 2 else shifted("old 6.5s", r.clip_offset))
