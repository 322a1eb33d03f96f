"""Streams that keep a state for each video or person, and the count of late rows.

State is kept by transformWithStateInPandas in typed maps and values, so that a batch reads and writes what it changes. It
needs the RocksDB state store, which session.prepare() sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.features import CARRY_GAP, CUT_SECONDS
from ..operators.tracks import BOX, TRACKED, Faces, placed

#: A video or person without rows for so long is forgotten. None keeps all: for runs that end when nothing is left to read
#: (availableNow), which would go on for ever to wait for the time to pass.
IDLE_MILLIS = 600_000


class Idle(StatefulProcessor):
    """A processor whose state for a key goes when no rows have come for a while: a timer is set anew with each batch of rows."""

    def __init__(self, idle_millis: int | None):
        self.idle = idle_millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def wait(self, timers) -> None:
        if self.idle is None:
            return
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle)

    def states(self) -> list:
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for s in self.states():
            s.clear()
        return iter([])

    def close(self) -> None:
        pass


def _mode(idle_millis: int | None) -> str:
    return "None" if idle_millis is None else "ProcessingTime"


class TrackVideo(Idle):
    """Faces of a video: `live` and `gone` ones by id, in the order in which they came (born), and what is counted."""

    def __init__(self, patience: int, idle_millis: int | None):
        super().__init__(idle_millis)
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.live = handle.getMapState("live", "face_id long", "born long, x1 double, y1 double, x2 double, y2 double, look array<double>, seen long")
        self.gone = handle.getMapState("gone", "face_id long", "born long, look array<double>")
        self.counts = handle.getValueState("counts", "last long, fresh long, born long")

    def states(self) -> list:
        return [self.live, self.gone, self.counts]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, fresh, born = self.counts.get() if self.counts.exists() else (-1, 0, 0)
        faces, look = Faces(self.patience), lambda x: None if x is None else np.asarray(x, "f8")
        was_live = {k[0]: tuple(v) for k, v in self.live.iterator()} if self.live.exists() else {}
        was_gone = {k[0]: tuple(v) for k, v in self.gone.iterator()} if self.gone.exists() else {}
        faces.fresh = fresh
        faces.live = {k: [np.array(v[1:5], "f8"), look(v[5]), v[6]] for k, v in sorted(was_live.items(), key=lambda x: x[1][0])}
        faces.gone = {k: look(v[1]) for k, v in sorted(was_gone.items(), key=lambda x: x[1][0])}
        pdf = pd.concat(list(rows))
        pdf = pdf[pdf["frame"] > last]
        if len(pdf):
            yield placed(faces, pdf)
            last = int(pdf["frame"].max())
            told = lambda x: None if x is None else [float(y) for y in x]
            born = self._store(self.live, was_live, {k: (*map(float, b), told(x), int(seen)) for k, (b, x, seen) in faces.live.items()}, born)
            born = self._store(self.gone, was_gone, {k: (told(x),) for k, x in faces.gone.items()}, born)
            self.counts.update((last, faces.fresh, born))
        self.wait(timerValues)

    @staticmethod
    def _store(state, was: dict[int, tuple], now: dict[int, tuple], born: int) -> int:
        """Writes what has changed of a map; those that came in between, or again, are born after all others."""
        for k in was.keys() - now.keys():
            state.removeKey((k,))
        before = -1
        for k, v in now.items():
            at = was[k][0] if k in was and was[k][0] > before else None
            if at is None:
                at, born = born, born + 1
            before = at
            if was.get(k) != (at, *v):
                state.updateValue((k,), (at, *v))
        return born


def track_faces(detections: DataFrame, patience: int = 999_999, idle_millis: int | None = IDLE_MILLIS) -> DataFrame:
    """operators.tracks.track_faces on a stream: what is known of a video is kept from batch to batch, until no rows have come
    for idle_millis. Frames of a video come in order; one that isn't after all frames of earlier batches is left out."""
    rows = detections.select("video_id", "frame", "det_id", *BOX, "embedding")
    return rows.groupBy("video_id").transformWithStateInPandas(TrackVideo(patience, idle_millis), TRACKED, "append", _mode(idle_millis))


CARRIED = "video_id string, person_id long, ts double, x double, y double, method string, confidence double"


class CarryPerson(Idle):
    """A person's last gaze, and how many rows have come since."""

    def __init__(self, most: int, seconds: float, idle_millis: int | None):
        super().__init__(idle_millis)
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "ts double, x double, y double, since long")

    def states(self) -> list:
        return [self.last]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        then, x, y, since = self.last.get() if self.last.exists() else (None, None, None, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values("ts").itertuples():
            if r.inout is not None and not pd.isna(r.inout) and r.inout and not pd.isna(r.gx) and not pd.isna(r.gy):
                then, x, y, since = float(r.ts), float(r.gx), float(r.gy), 0
                out.append((r.ts, x, y, "measured", 1.0))
                continue
            since += 1
            if then is not None and r.ts - then > self.seconds:
                out.append((r.ts, None, None, "null_scene_cut", 0.0))
            elif then is not None and since <= self.most:
                out.append((r.ts, x, y, "carry_forward", 0.5 * float(np.exp(-0.2 * since))))
            else:
                out.append((r.ts, None, None, "null_no_valid", 0.0))
        self.last.update((then, x, y, since))
        self.wait(timerValues)
        yield pd.DataFrame([(*key, *r) for r in out], columns=["video_id", "person_id", "ts", "x", "y", "method", "confidence"])


def carry_forward(gaze: DataFrame, most: int = CARRY_GAP, seconds: float = CUT_SECONDS, idle_millis: int | None = IDLE_MILLIS) -> DataFrame:
    """The gaze of each row as it comes: its own if measured, else the person's last one, of at most `most` rows and `seconds`
    before; its confidence falls with the rows between. What comes later isn't looked at, as in the batch rule.

    gaze: video_id, person_id, ts, gx, gy, inout; a person's rows come in order of ts from batch to batch."""
    rows = gaze.select("video_id", "person_id", "ts", "gx", "gy", "inout")
    return rows.groupBy("video_id", "person_id").transformWithStateInPandas(CarryPerson(most, seconds, idle_millis), CARRIED, "append", _mode(idle_millis))


class LateRows(StreamingQueryListener):
    """Adds up, by query, the rows that are dropped as later than their watermark: of all batches, as a query's own recent
    progress forgets the older ones. Add it with spark.streams.addListener() before queries start."""

    def __init__(self):
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.dropped[str(p.id)] = self.dropped.get(str(p.id), 0) + sum(s.numRowsDroppedByWatermark for s in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def of(self, query) -> int:
        return self.dropped.get(str(query.id), 0)
