"""Tracks of persons over frames and chunks: faces to persons, chunks to one another, identities by likeness.

Rules that look at a frame or at neighbouring chunks run on those alone; only chains of ids within a video are followed
in one place, on a row for each person of a chunk.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box_iou, centre, cosine, distance, inside
from .features import KEY
from .prefix import running_sums

BOX = ["x1", "y1", "x2", "y2"]


def assign(cost: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Rows and columns of the cheapest one-to-one choice, those of cost under `most`: shortest augmenting paths."""
    if not cost.size:
        return []
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    u, v, owner, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        least, done = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while owner[j]:
            done[j] = True
            slack = c[owner[j] - 1] - u[owner[j]] - v[1:]
            open_ = ~done[1:]
            better = open_ & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j
            k = 1 + int(np.flatnonzero(open_)[np.argmin(least[1:][open_])])
            step = least[k]
            u[owner[done]] += step
            v[done] -= step
            least[~done] -= step
            j = k
        while j:
            owner[j] = owner[way[j]]
            j = way[j]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if turned else (a, b) for a, b in pairs if c[a, b] < most)


def _box(p: str = "") -> list:
    return [F.col(p + c) for c in BOX]


def chosen(pairs: DataFrame, keys: list[str], left: str, right: str, most: float) -> DataFrame:
    """The cheapest one-to-one choice among pairs (left, right, cost) of each group of keys; a pair that is absent can't be
    chosen. Groups are frames, of some persons each."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = sorted(set(pdf[left])), sorted(set(pdf[right]))
        at = {(a, b): k for k, (a, b) in enumerate(zip(pdf[left], pdf[right]))}
        cost = np.full((len(rows), len(cols)), 1e6)
        for (a, b), k in at.items():
            cost[rows.index(a), cols.index(b)] = pdf["cost"].iloc[k]
        return pdf.iloc[[at[rows[a], cols[b]] for a, b in assign(cost, min(most, 1e5))]]

    return pairs.groupBy(*keys).applyInPandas(pick, pairs.schema)


def match_faces(faces: DataFrame, persons: DataFrame) -> DataFrame:
    """Faces (video_id, frame, face_id, box) to persons (video_id, frame, person_id, box): the centre in the person's box,
    cheapest by 1 - IoU with the box's upper half. Returns video_id, frame, face_id, person_id, cost."""
    both = faces.select(*KEY, "frame", "face_id", *_box()).join(persons.select(*KEY, "frame", "person_id", *(F.col(c).alias(f"p{c}") for c in BOX)), [*KEY, "frame"])
    x, y = centre(_box())
    p = _box("p")
    upper = [p[0], p[1], p[2], (p[1] + p[3]) / 2]
    pairs = both.where(inside(x, y, p, 0.0)).select(*KEY, "frame", "face_id", "person_id", (1 - box_iou(_box(), upper)).alias("cost"))
    return chosen(pairs, [*KEY, "frame"], "face_id", "person_id", 1.0)


def confident(boxes: DataFrame, least: float = 0.4) -> DataFrame:
    """Boxes (left, top, width, height, score) of enough score, with corners; a missing side counts as 0."""
    side = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return boxes.where(F.col("score") >= least).withColumns({"x1": side("left"), "y1": side("top"), "x2": side("left") + side("width"), "y2": side("top") + side("height")})


def stitch(rows: DataFrame, least: float = 0.3, overlap: int = 5) -> DataFrame:
    """Chunks' own ids to ids of the video: a person of a chunk's first frame is the one of the chunk before whose box in
    its last frame fits best (IoU of `least` or more), else new. Rows of a chunk's first `overlap` frames, which the one
    before has too, are left out. rows: video_id, chunk, frame (in the chunk), person_id, box. Adds track_id.

    Neighbouring chunks are compared in parallel; the chains of ids are then followed by video, on a row a person and chunk."""
    last = F.max("frame").over(Window.partitionBy(*KEY, "chunk"))
    ends = rows.withColumn("_last", last)
    before = ends.where("frame = _last").select(*KEY, (F.col("chunk") + 1).alias("chunk"), F.col("person_id").alias("before"), *(F.col(c).alias(f"p{c}") for c in BOX))
    now = rows.where("frame = 0").select(*KEY, "chunk", "person_id", *BOX)
    cost = (1 - box_iou(_box(), _box("p"))).alias("cost")
    links = chosen(now.join(before, [*KEY, "chunk"]).select(*KEY, "chunk", "before", "person_id", cost), [*KEY, "chunk"], "before", "person_id", 1 - least + 1e-9)
    each = rows.select(*KEY, "chunk", "person_id").distinct().join(links.drop("cost"), [*KEY, "chunk", "person_id"], "left")

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, fresh, out = {}, 0, []
        for r in pdf.sort_values(["chunk", "person_id"]).itertuples():
            known = ids.get((r.chunk - 1, r.before)) if not pd.isna(r.before) else None
            if known is None:
                known, fresh = fresh, fresh + 1
            ids[r.chunk, r.person_id] = known
            out.append(known)
        return pdf.sort_values(["chunk", "person_id"])[[*KEY, "chunk", "person_id"]].assign(track_id=out)

    named = each.groupBy(*KEY).applyInPandas(follow, "video_id string, chunk long, person_id long, track_id long")
    kept = rows.where((F.col("chunk") == 0) | (F.col("frame") >= overlap))
    return kept.join(named, [*KEY, "chunk", "person_id"])


def mean_embeddings(rows: DataFrame) -> DataFrame:
    """The mean of each person's embeddings, of length 1. rows: video_id, person_id, embedding; nulls don't count."""
    parts = rows.where("embedding IS NOT NULL").select(*KEY, "person_id", F.posexplode("embedding").alias("k", "v"))
    mean = parts.groupBy(*KEY, "person_id", "k").agg(F.avg("v").alias("v"))
    whole = mean.groupBy(*KEY, "person_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("embedding"))
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    return whole.withColumn("embedding", F.transform("embedding", lambda x: x / F.greatest(size, F.lit(1e-12))))


def reidentify(means: DataFrame, least: float = 0.6) -> DataFrame:
    """video_id, person_id, same_as: in order of ids each person not yet taken takes the later ones alike by `least` or
    more. Likeness is worked out by a join; the greedy order is followed by video, on pairs alike alone."""
    b = means.select(*KEY, F.col("person_id").alias("b"), F.col("embedding").alias("_e"))
    pairs = means.withColumnRenamed("person_id", "a").join(b, KEY).where((F.col("a") < F.col("b")) & (cosine(F.col("embedding"), F.col("_e")) >= least)).select(*KEY, "a", "b")

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        same = {}
        for a, rows in pdf.sort_values(["a", "b"]).groupby("a", sort=True):
            if a not in same:
                for x in rows["b"]:
                    same.setdefault(x, a)
        return pd.DataFrame({"video_id": pdf["video_id"].iloc[0], "person_id": list(same), "same_as": list(same.values())})

    found = pairs.groupBy(*KEY).applyInPandas(take, "video_id string, person_id long, same_as long")
    return means.select(*KEY, "person_id").join(found, [*KEY, "person_id"], "left").withColumn("same_as", F.coalesce("same_as", "person_id"))


def with_faces(rows: DataFrame) -> DataFrame:
    """Rows of persons that have a face in some frame. rows: video_id, person_id, face_detected."""
    seen = rows.where("face_detected").select(*KEY, "person_id").distinct()
    return rows.join(seen, [*KEY, "person_id"], "left_semi")


def auc(rows: DataFrame) -> DataFrame:
    """Area under the ROC curve (equal scores count half) and average precision. rows: score, label (0 or 1).

    Counted by distinct score, then summed up in order of scores by ranges of them: real scores are nearly all distinct."""
    each = rows.groupBy("score").agg(F.sum("label").alias("p"), (F.count("*") - F.sum("label")).alias("n"))
    at = running_sums(each, [F.col("score").desc()], {"above": F.col("p"), "beyond": F.col("p") + F.col("n")})
    pos, neg = F.sum("p"), F.sum("n")
    area = F.sum(F.col("n") * (F.col("above") + F.col("p") / 2)) / (pos * neg)
    step = F.col("p") * (F.col("above") + F.col("p")) / (F.col("beyond") + F.col("p") + F.col("n"))
    return at.agg(area.alias("auc"), (F.sum(step) / pos).alias("average_precision"))


def point_errors(rows: DataFrame) -> DataFrame:
    """For each video: points, mean and greatest distance of a predicted gaze point (px, py) from the true one (gx, gy); rows that
    lack either don't count."""
    error = distance(F.col("px"), F.col("py"), F.col("gx"), F.col("gy"))
    return rows.groupBy(*KEY).agg(F.count(error).alias("points"), F.avg(error).alias("mean_error"), F.max(error).alias("greatest_error"))


class Faces:
    """Who is tracked in a video: last box, smoothed embedding and frame last seen by id; and those gone, by embedding.

    place() takes a frame's detections at a time. A track not seen for more than `patience` frames is gone; its id comes
    back with a face that is alike (cosine distance under `far`)."""

    def __init__(self, patience: int, overlap: float = 0.3, far: float = 0.7, looks: float = 0.4, kept: float = 0.7):
        self.patience, self.overlap, self.far, self.looks, self.kept = patience, overlap, far, looks, kept
        self.live: dict[int, list] = {}
        self.gone: dict[int, np.ndarray] = {}
        self.fresh = 0

    def place(self, frame: int, boxes: np.ndarray, looks: list[np.ndarray | None]) -> list[int]:
        """The id of each detection of a frame; frames come in order."""
        for k in [k for k, (_, _, seen) in self.live.items() if frame - 1 - seen > self.patience]:
            if self.live[k][1] is not None:
                self.gone[k] = self.live[k][1]
            del self.live[k]
        ids, out = list(self.live), [-1] * len(boxes)
        if ids:
            fit = _fits(np.stack([self.live[k][0] for k in ids]), boxes)
            apart = np.array([[_apart(self.live[k][1], x) for x in looks] for k in ids])
            both = np.array([[self.live[k][1] is not None and x is not None for x in looks] for k in ids])
            cost = np.where(both, (1 - self.looks) * (1 - fit) + self.looks * apart, 1 - fit)
            for a, b in assign(cost, np.inf):
                if fit[a, b] >= self.overlap or (looks[b] is not None and apart[a, b] < self.far):
                    old = self.live[ids[a]][1]
                    mean = old if looks[b] is None else looks[b] if old is None else self.kept * old + (1 - self.kept) * looks[b]
                    self.live[ids[a]], out[b] = [boxes[b], mean, frame], ids[a]
        for b in [b for b, k in enumerate(out) if k < 0]:
            out[b] = self._named(looks[b])
            self.live[out[b]] = [boxes[b], looks[b], frame]
        return out

    def _named(self, look: np.ndarray | None) -> int:
        if look is not None and self.gone:
            k = min(self.gone, key=lambda k: _apart(look, self.gone[k]))
            if _apart(look, self.gone[k]) < self.far:
                del self.gone[k]
                return k
        self.fresh += 1
        return self.fresh - 1


def _fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of each box of a with each of b."""
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    shared = np.prod(np.maximum(high - low, 0), axis=2)
    whole = np.prod(a[:, 2:] - a[:, :2], axis=1)[:, None] + np.prod(b[:, 2:] - b[:, :2], axis=1)[None] - shared
    return np.where(whole > 0, shared / np.where(whole > 0, whole, 1), 0.0)


def _apart(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Cosine distance, 1 where an embedding is missing."""
    if a is None or b is None:
        return 1.0
    return 1 - float(a @ b) / ((float(np.linalg.norm(a)) + 1e-8) * (float(np.linalg.norm(b)) + 1e-8))


TRACKED = "video_id string, frame long, det_id long, face_id long"


def placed(faces: Faces, pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of TRACKED for the detections of a video, frame by frame."""
    pdf = pdf.sort_values(["frame", "det_id"])
    ids = []
    for frame, rows in pdf.groupby("frame", sort=True):
        looks = [None if x is None else np.asarray(x, "f8") for x in rows["embedding"]]
        ids += faces.place(int(frame), rows[BOX].to_numpy("f8"), looks)
    return pdf[["video_id", "frame", "det_id"]].assign(face_id=np.array(ids, "i8"))


def track_faces(detections: DataFrame, patience: int = 999_999) -> DataFrame:
    """An id for each face over the frames of a video. detections: video_id, frame, det_id, box, embedding (or null).

    Each frame depends on the one before, so a video is one group: one of minutes, some hundred frames of some faces.
    Frames without faces have no rows. streaming.state.track_faces does the same on a stream."""
    return detections.select(*KEY, "frame", "det_id", *BOX, "embedding").groupBy(*KEY).applyInPandas(lambda pdf: placed(Faces(patience), pdf), TRACKED)
