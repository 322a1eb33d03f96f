"""The filtered timeline beside a plain loop over each video."""

import oracle

from sightline.plans import queries


def overlap(a, b):
    return a.start_time < b.end_time and b.start_time < a.end_time


def kept(rows, most=25):
    safe = set()
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if (a.source, b.source) == ("gaze", "gesture") and (overlap(a, b) or max(a.start_time, b.start_time) - min(a.end_time, b.end_time) <= 3):
                safe |= {i, j}
    left = set(range(len(rows)))
    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)):
            b = rows[j]
            if i not in left:
                break
            if j not in left or (a.source, a.kind) != (b.source, b.kind) or set(a.persons.split(",")) != set(b.persons.split(",")) or not overlap(a, b) or {i, j} <= safe:
                continue
            drop = j if a.confidence >= b.confidence else i
            left -= {drop} - safe
    left = sorted(left)
    if len(left) <= most:
        return left
    first = {}
    for i in left:
        first.setdefault((rows[i].source, rows[i].kind), i)
    must = (safe & set(left)) | set(first.values())
    rest = sorted((i for i in left if i not in must), key=lambda i: -rows[i].confidence)
    return sorted(must | set(rest[: max(0, most - len(must))]))


def test_filter_timeline_equals_loop(spark):
    got = queries.QUERIES["e9_filter_timeline"](spark, oracle.SF).toPandas().groupby("video_id").place.apply(sorted)
    every = queries.QUERIES["e8_merge_timeline"](spark, oracle.SF).toPandas().sort_values("place")
    for video, rows in every.groupby("video_id"):
        assert got[video] == kept(list(rows.itertuples())), video
