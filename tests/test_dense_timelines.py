"""Timelines in which many events share their spans, and doubles that aren't protected, beside plain loops."""

import random
import time

from pyspark.sql import functions as F
from test_filter_timeline import kept, overlap

from sightline.operators import timeline

COLUMNS = "video_id string, place int, source string, item long, kind string, start_time double, end_time double, confidence double, persons array<int>"


def rows(spark, seed, n, gaze, ends=120):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        source = "gaze" if rng.random() < gaze else "gesture"
        a = rng.randrange(ends) / 2
        out.append((a, a + rng.choice([0.0, 0.5, 1.0, 3.0]), source, k, rng.choice("xy"), rng.choice([0.9, 0.95, 1.0]), rng.sample(range(2), rng.randrange(1, 3))))
    out.sort(key=lambda r: r[:4])
    return spark.createDataFrame([("v", p, s, k, kind, a, z, c, who) for p, (a, z, s, k, kind, c, who) in enumerate(out)], COLUMNS)


def plain(df):
    return df.withColumn("persons", F.array_join("persons", ",")).orderBy("place").collect()


def test_doubles_equal_loop(spark):
    """Without gaze nothing is protected; with little of it, protected and other doubles meet."""
    for seed, (n, gaze) in enumerate([(60, 0.0), (200, 0.0), (200, 0.01), (200, 0.03), (150, 0.5)]):
        df = rows(spark, seed, n, gaze)
        got = sorted(r.place for r in timeline.filter_timeline(df, 0.5 if gaze < 0.5 else 3.0, 10_000).collect())
        want = kept(plain(df), 10_000) if gaze in (0.0, 0.5) else loop(plain(df), 0.5)
        assert got == want, (seed, len(got), len(want))


def loop(events, reach):
    near = lambda a, b: overlap(a, b) or max(a.start_time, b.start_time) - min(a.end_time, b.end_time) <= reach
    safe = {p for i, a in enumerate(events) for j, b in enumerate(events) if (a.source, b.source) == ("gaze", "gesture") and near(a, b) for p in (i, j)}
    left = set(range(len(events)))
    for i, a in enumerate(events):
        for j in range(i + 1, len(events)):
            b = events[j]
            alike = (a.source, a.kind) == (b.source, b.kind) and set(a.persons.split(",")) == set(b.persons.split(","))
            if i in left and j in left and alike and overlap(a, b) and not {i, j} <= safe:
                left -= {j if a.confidence >= b.confidence else i} - safe
    return sorted(left)


def test_dense_doubles_are_not_quadratic(spark):
    """Eight thousand events alike in one run, none of them protected."""
    df = rows(spark, 9, 8_000, 0.0, 40).withColumns({"kind": F.lit("x"), "persons": F.array(F.lit(1)), "end_time": F.col("end_time") + 0.5})
    began = time.time()
    assert 0 < timeline.filter_timeline(df, n=100_000).count() < 100
    assert time.time() - began < 60


def test_pairs_of_spans(spark):
    """Pairs, their number and the places in them are those of a loop, and equal spans are paired once."""
    df = rows(spark, 5, 300, 0.4, 30)
    events = plain(df)
    want = set()
    for a in events:
        for b in events:
            apart = max(a.start_time, b.start_time) - min(a.end_time, b.end_time)
            if (a.source, b.source) == ("gaze", "gesture") and (overlap(a, b) or apart <= 3):
                want.add((a.place, b.place, "overlap" if overlap(a, b) else "adjacent", round(abs(apart), 2)))
    got = [(r.gaze_place, r.gesture_place, r.relation, r.seconds) for r in timeline.cross_modal_pairs(df).collect()]
    assert set(got) == want and len(got) == len(want)
    assert timeline.pair_counts(df).collect()[0].pairs == len(want)
    places = [r.place for r in timeline.paired_places(df).collect()]
    assert sorted(places) == sorted({w[k] for w in want for k in (0, 1)})
    assert timeline.span_pairs(df).count() < len(want) / 2


def test_many_equal_spans(spark):
    """30,000 events of each source at one time: 900 million pairs are counted and none is made."""
    one = spark.range(60_000).selectExpr("'v' AS video_id", "cast(id AS int) AS place", "if(id < 30000, 'gaze', 'gesture') AS source", "1.0D AS start_time", "2.0D AS end_time")
    began = time.time()
    assert timeline.pair_counts(one).collect()[0].pairs == 900_000_000
    assert timeline.paired_places(one).count() == 60_000 and time.time() - began < 40
