"""Matching in order beside a plain loop, and how its work grows."""

import random
import time

from sightline.operators import evaluate, matching

COLUMNS = "video_id string, gesture_type string, {} long, start_time double, end_time double"


def loop(pred, truth, listed):
    order = (lambda r: r[2]) if listed else (lambda r: (r[0], r[2]))
    used, out = set(), set()
    for p in sorted(pred, key=order):
        for k, t in sorted(enumerate(truth), key=lambda x: order(x[1])):
            if k not in used and p[0] <= t[1] and t[0] <= p[1]:
                used.add(k)
                out.add((p[2], t[2]))
                break
    return out


def spans(n, rng, whole):
    at = [(rng.randrange(60) / 2 if whole else rng.random() * 30) for _ in range(n)]
    keys = rng.sample(range(n * 3), n)
    return [(a, a + rng.choice([-1.0, 0.0, 0.5, 1.5, 6.0]) * (1 if whole else rng.random()), k) for a, k in zip(at, keys)]


def run(rule, pred, truth):
    rows = sorted([(*p, False) for p in pred] + [(*t, True) for t in truth], key=lambda r: (r[0], not r[3], r[2]))
    state, met = rule(), []
    for k in range(0, len(rows), 7):
        state.feed(((a, z, t, key, key) for a, z, key, t in rows[k : k + 7]), met)
    state.end(met)
    return [(m[2], m[5]) for m in met]


def test_rules_equal_loop():
    """Spans on a grid and off it, of no length, and some that end before they start."""
    rng = random.Random(4)
    for n in range(150):
        pred, truth = spans(rng.randrange(40), rng, n % 2), spans(rng.randrange(30), rng, n % 2)
        for rule, listed in ((matching.InTime, False), (matching.Listed, True)):
            got = run(rule, pred, truth)
            assert set(got) == loop(pred, truth, listed) and len(set(got)) == len(got), (n, listed)


def test_dense_runs_are_not_quadratic():
    """12,000 predictions and 6,000 truths that all hang together: 2 million pairs, of which none is made."""
    rng = random.Random(5)
    row = lambda k, most: (at := rng.random() * 100, at + rng.random() * most, k)
    pred, truth = [row(k, 6) for k in range(12_000)], [row(k, 6) for k in range(6_000)]
    began = time.process_time()
    for rule in (matching.InTime, matching.Listed):
        assert len(run(rule, pred, truth)) > 5_000
    assert time.process_time() - began < 10


def test_dense_video(spark):
    """Groups apart, rows that lack something match nothing, keys that are structs."""
    rng = random.Random(6)
    pred = [(v, k, *(p[2], p[0], p[1])) for v in "ab" for k in ("x", "y") for p in spans(300, rng, True)]
    truth = [(v, k, *(p[2], p[0], p[1])) for v in "ab" for k in ("x", "z") for p in spans(200, rng, True)]
    odd = [(None, "x", 1, 0.0, 30.0), ("a", None, 2, 0.0, 30.0), ("a", "x", -3, None, 30.0), ("a", "x", -4, 0.0, None)]
    p, g = spark.createDataFrame(pred + odd, COLUMNS.format("gesture_key")), spark.createDataFrame(truth + odd, COLUMNS.format("gt_key"))
    rows = lambda side, v: [(s, e, k) for w, t, k, s, e in side if (w, t) == (v, "x")]
    for listed in (False, True):
        found = evaluate.greedy_match(g, p, listed)
        assert found.columns == ["video_id", "gesture_type", "gesture_key", "gt_key", "seconds"]
        got = {(r.video_id, r.gesture_key, r.gt_key): r.seconds for r in found.collect()}
        assert set(got) == {(v, *m) for v in "ab" for m in loop(rows(pred, v), rows(truth, v), listed)} and got
        assert min(got.values()) == 0.0 and max(got.values()) > 1
    keyed = p.selectExpr("video_id", "gesture_type", "struct(cast(gesture_key % 5 as int) AS segment, gesture_key) AS gesture_key", "start_time", "end_time")
    again = {(r.video_id, r.gesture_key.gesture_key, r.gt_key) for r in evaluate.greedy_match(g, keyed, True).collect()}
    turned = {v: loop([(s, e, (k % 5, k)) for s, e, k in rows(pred, v)], rows(truth, v), True) for v in "ab"}
    assert again == {(v, k[1], t) for v, found in turned.items() for k, t in found}
