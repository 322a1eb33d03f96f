"""Assignments, chains of tracks and identities beside plain loops."""

from itertools import permutations

import numpy as np

import __spark_entry__ as entry
from sightline.operators import tracks
from sightline.plans import tracks as plans

SF = "/root/testdata/sf0.001"


def iou(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def test_assign_equals_all_permutations():
    r = np.random.default_rng(1)
    for _ in range(200):
        n, m = (int(x) for x in r.integers(1, 6, 2))
        c = r.random((n, m))
        got = tracks.assign(c, 10.0)
        k = min(n, m)
        best = min(sum(c[i, j] for i, j in zip(range(n), p)) for p in permutations(range(m), n)) if n <= m else min(sum(c[i, j] for i, j in zip(p, range(m))) for p in permutations(range(n), m))
        assert len(got) == k and abs(sum(c[a, b] for a, b in got) - best) < 1e-9
    assert tracks.assign(np.array([[0.2, 5.0], [5.0, 9.0]]), 1.0) == [(0, 0)] and tracks.assign(np.zeros((0, 3)), 1) == []


def test_match_faces(spark):
    faces, bodies = (d.collect() for d in plans._boxes(spark, SF))
    box = lambda r: (r.x1, r.y1, r.x2, r.y2)
    frames = {}
    for r in faces:
        frames.setdefault((r.video_id, r.frame), ([], []))[0].append(r)
    for r in bodies:
        frames[r.video_id, r.frame][1].append(r)
    got = {}
    for r in entry.queries()["e16_match_faces"](spark, SF).collect():
        got.setdefault((r.video_id, r.frame), {})[r.face_id] = (r.person_id, r.cost)
    for key, (fs, ps) in frames.items():
        cost = {}
        for f in fs:
            for p in ps:
                x, y = (f.x1 + f.x2) / 2, (f.y1 + f.y2) / 2
                if p.x1 <= x <= p.x2 and p.y1 <= y <= p.y2:
                    cost[f.face_id, p.person_id] = 1 - iou(box(f), (p.x1, p.y1, p.x2, (p.y1 + p.y2) / 2))
        ids = [p.person_id for p in ps]
        best = min((sum(cost.get((f.face_id, q), 1e6) for f, q in zip(fs, perm)) for perm in permutations(ids, len(fs))), default=0)
        mine = got.get(key, {})
        assert all(c == cost[f, p] for f, (p, c) in mine.items())
        missing = len(fs) - len(mine)
        assert abs(sum(c for _, c in mine.values()) + missing * 1e6 - best) < 1


def test_stitch(spark):
    """Chunk by chunk: the cheapest assignment by trying all, then ids handed on or new ones in order."""
    rows = plans._chunks(spark, SF).collect()
    box = lambda r: (r.x1, r.y1, r.x2, r.y2)
    chunks = {}
    for r in rows:
        chunks.setdefault(r.video_id, {}).setdefault(r.chunk, []).append(r)
    want = {}
    for video, own in chunks.items():
        ids, fresh = {}, 0
        for c in sorted(own):
            links = {}
            if c - 1 in own:
                last = max(r.frame for r in own[c - 1])
                before, now = [r for r in own[c - 1] if r.frame == last], [r for r in own[c] if r.frame == 0]
                few, many = (before, now) if len(before) <= len(now) else (now, before)
                best = min(permutations(many, len(few)), key=lambda p: sum(1 - iou(box(a), box(b)) for a, b in zip(few, p)))
                for a, b in zip(few, best):
                    if iou(box(a), box(b)) >= 0.3:
                        a, b = (a, b) if few is before else (b, a)
                        links[b.person_id] = a.person_id
            for person in sorted({r.person_id for r in own[c]}):
                known = ids.get((c - 1, links.get(person)))
                if known is None:
                    known, fresh = fresh, fresh + 1
                ids[c, person] = known
            for r in own[c]:
                if c == 0 or r.frame >= 5:
                    want[video, c, r.frame, r.person_id] = ids[c, r.person_id]
    got = {(r.video_id, r.chunk, r.frame, r.person_id): r.track_id for r in tracks.stitch(plans._chunks(spark, SF)).collect()}
    assert got == want and len(set(want.values())) > 1


def test_reidentify(spark):
    means = tracks.mean_embeddings(plans._people(spark, SF))
    people = {}
    for r in means.collect():
        people.setdefault(r.video_id, {})[r.person_id] = np.array(r.embedding)
    want = {}
    for v, own in people.items():
        for a in sorted(own):
            if (v, a) in want:
                continue
            want[v, a] = a
            for b in sorted(own):
                if b > a and (v, b) not in want and own[a] @ own[b] >= 0.2:
                    want[v, b] = a
    assert {(r.video_id, r.person_id): r.same_as for r in tracks.reidentify(means, 0.2).collect()} == want
    assert len(set(want.values())) < len(want)
