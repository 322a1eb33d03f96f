"""The confusion of kinds beside a plain loop."""

import random
import time
from collections import Counter

from sightline.operators import evaluate


def test_confusion_equals_loop(spark):
    """Many equal spans, spans of no length, kinds and keys that decide between equals, a video without the other side, nulls."""
    rng = random.Random(3)
    kinds = ["pointing", "showing", "giving"]

    def rows(videos, n):
        out = []
        for v in videos:
            for k in rng.sample(range(10 * n), n):
                a = rng.randrange(12) / 2
                out.append((v, rng.choice(kinds), k, a, a + rng.choice([0.0, 0.5, 1.0, 4.0])))
        return out

    gt, pred = rows("abx", 40), rows("aby", 60)
    gt += [("a", "giving", 900, None, 3.0), ("a", "giving", 901, 30.0, 31.0)]
    pred += [("a", "giving", 902, 1.0, None), ("a", None, 903, 2.0, 3.0)]
    want, used = Counter(), set()
    for v, kind, _, a, z in gt:
        over = [(-(min(z, e) - max(a, s)), s, k, t) for w, t, k, s, e in pred if w == v and None not in (a, z, s, e) and min(z, e) > max(a, s)]
        best = min(over, key=lambda x: x[:3], default=None)
        want[kind, best and best[3]] += 1
        if best:
            used.add((v, best[2]))
    want.update((None, t) for v, t, k, *_ in pred if (v, k) not in used)
    columns = "video_id string, gesture_type string, {} long, start_time double, end_time double"
    cells = evaluate.confusion(spark.createDataFrame(gt, columns.format("gt_key")), spark.createDataFrame(pred, columns.format("gesture_key")))
    assert {(r.gt_type, r.pred_type): r.n for r in cells.collect()} == dict(want)


def test_pairs_are_not_made(spark):
    """Forty thousand equal spans on each side are one pair, not 1.6 billion."""
    row = spark.range(40_000).selectExpr("'v' AS video_id", "'giving' AS gesture_type", "1.0D AS start_time", "2.0D AS end_time", "id")
    cells = evaluate.confusion(row.withColumnRenamed("id", "gt_key"), row.withColumnRenamed("id", "gesture_key"))
    began = time.time()
    assert {(r.gt_type, r.pred_type): r.n for r in cells.collect()} == {("giving", "giving"): 40_000, (None, "giving"): 39_999}
    assert time.time() - began < 40
