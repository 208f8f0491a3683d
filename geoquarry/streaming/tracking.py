"""Multi-object tracking over frames: Kalman filters, two-stage association, keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoquarry.operators.kernels import assign_within, box_iou

NEW, TRACKED, LOST, REMOVED = 0, 1, 2, 3
#: Fixed value: 95 % quantiles of chi-square by degrees of freedom.
CHI2 = {1: 3.8415, 2: 5.9915, 3: 7.8147, 4: 9.4877}


@dataclass
class Options:
    high: float = 0.5
    low: float = 0.1
    new: float = 0.6
    match: float = 0.8
    second: float = 0.5
    unconfirmed: float = 0.7
    buffer: int = 30
    rate: int = 30
    size_noise: str = "height"  # "height": centre, aspect, height; "both": centre, width, height


class Kalman:
    """Constant velocity over four measures. With ``height`` these are centre, aspect and height and noise follows the height; with ``both`` centre, width and height, noise following each side."""

    position, velocity = 1 / 20, 1 / 160

    def __init__(self, mode: str = "height") -> None:
        self.mode = mode
        self.step = np.eye(8) + np.eye(8, k=4)

    def _noise(self, mean: np.ndarray, kind: str) -> np.ndarray:
        w, h = (mean[3], mean[3]) if self.mode == "height" else (mean[2], mean[3])
        p, v = {"start": (2 * self.position, 10 * self.velocity), "step": (self.position, self.velocity), "measure": (self.position, 0.0)}[kind]
        place, speed = np.array([p * w, p * h, p * w, p * h]), np.array([v * w, v * h, v * w, v * h])
        if self.mode == "height":
            place[2], speed[2] = {"start": (1e-2, 1e-5), "step": (1e-2, 1e-5), "measure": (1e-1, 0.0)}[kind]
        return place if kind == "measure" else np.concatenate([place, speed])

    def start(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = np.concatenate([z, np.zeros(4)])
        return mean, np.diag(self._noise(mean, "start") ** 2)

    def predict_all(self, means: np.ndarray, covs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``predict`` of many tracks at once."""
        w = means[:, 3] if self.mode == "height" else means[:, 2]
        p, v = self.position, self.velocity
        noise = np.stack([p * w, p * means[:, 3], p * w, p * means[:, 3], v * w, v * means[:, 3], v * w, v * means[:, 3]], axis=1)
        if self.mode == "height":
            noise[:, 2], noise[:, 6] = 1e-2, 1e-5
        out = self.step @ covs @ self.step.T
        out[:, np.arange(8), np.arange(8)] += noise**2
        return means @ self.step.T, out

    def predict(self, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.step @ mean, self.step @ cov @ self.step.T + np.diag(self._noise(mean, "step") ** 2)

    def project(self, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return mean[:4], cov[:4, :4] + np.diag(self._noise(mean, "measure") ** 2)

    def update(self, mean: np.ndarray, cov: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, s = self.project(mean, cov)
        gain = np.linalg.solve(s, cov[:4]).T
        return mean + gain @ (z - m), cov - gain @ s @ gain.T

    def gate(self, mean: np.ndarray, cov: np.ndarray, zs: np.ndarray) -> np.ndarray:
        """Squared Mahalanobis distances of measures."""
        m, s = self.project(mean, cov)
        d = np.linalg.solve(np.linalg.cholesky(s), (zs - m).T)
        return (d * d).sum(0)


def measure(box: np.ndarray, mode: str) -> np.ndarray:
    w, h = box[2] - box[0], box[3] - box[1]
    return np.array([(box[0] + box[2]) / 2, (box[1] + box[3]) / 2, w / max(h, 1e-9) if mode == "height" else w, h])


def corners(mean: np.ndarray, mode: str) -> np.ndarray:
    w = mean[2] * mean[3] if mode == "height" else mean[2]
    return np.array([mean[0] - w / 2, mean[1] - mean[3] / 2, mean[0] + w / 2, mean[1] + mean[3] / 2])


@dataclass
class Track:
    track_id: int
    state: int
    active: bool
    start: int
    frame: int
    score: float
    cls: int
    mean: np.ndarray
    cov: np.ndarray
    hits: int = 1

    def plain(self) -> dict:
        return {**self.__dict__, "mean": self.mean.tolist(), "cov": self.cov.ravel().tolist()}

    @staticmethod
    def of(raw: dict) -> "Track":
        return Track(**{**raw, "mean": np.array(raw["mean"]), "cov": np.array(raw["cov"]).reshape(8, 8)})


@dataclass
class State:
    """All that a stream's tracker keeps: its tracks, the last frame and the next id; JSON both ways."""

    frame: int = 0
    seen: int = -1
    next_id: int = 1
    tracks: list[Track] = field(default_factory=list)

    def dump(self) -> str:
        return json.dumps({**self.__dict__, "tracks": [t.plain() for t in self.tracks]})

    @staticmethod
    def load(text: str | None) -> "State":
        if not text:
            return State()
        raw = json.loads(text)
        return State(raw["frame"], raw["seen"], raw["next_id"], [Track.of(t) for t in raw["tracks"]])


def corners_of(tracks: list[Track], mode: str) -> np.ndarray:
    m = np.array([t.mean[:4] for t in tracks])
    w = m[:, 2] * m[:, 3] if mode == "height" else m[:, 2]
    return np.stack([m[:, 0] - w / 2, m[:, 1] - m[:, 3] / 2, m[:, 0] + w / 2, m[:, 1] + m[:, 3] / 2], axis=1)


def iou_cost(tracks: list[Track], boxes: np.ndarray, mode: str) -> np.ndarray:
    if not tracks or not len(boxes):
        return np.zeros((len(tracks), len(boxes)))
    return 1 - box_iou(corners_of(tracks, mode), boxes)


def with_scores(cost: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """1 - IoU times score."""
    return 1 - (1 - cost) * scores[None] if cost.size else cost


def cosine_cost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    return np.maximum(0.0, 1 - unit(a) @ unit(b).T)


def with_appearance(cost: np.ndarray, overlap: np.ndarray) -> np.ndarray:
    """Appearance similarity weighted by overlap."""
    return 1 - (1 - cost) * (1 + (1 - overlap)) / 2


def gated(cost: np.ndarray, kalman: Kalman, tracks: list[Track], measures: np.ndarray, weight: float | None = None) -> np.ndarray:
    """Pairs beyond the gate become impossible; with a weight, the distance is mixed in."""
    out = cost.copy()
    for i, t in enumerate(tracks):
        d = kalman.gate(t.mean, t.cov, measures)
        out[i, d > CHI2[4]] = np.inf
        if weight is not None:
            out[i] = weight * out[i] + (1 - weight) * d
    return out


def warped(track: Track, matrix: np.ndarray) -> None:
    """Moves a track by the camera's motion, a 2 by 3 affine matrix."""
    r = np.kron(np.eye(4), matrix[:, :2])
    mean = r @ track.mean
    mean[:2] += matrix[:, 2]
    track.mean, track.cov = mean, r @ track.cov @ r.T


class Tracker:
    """Two-stage association of one stream, frame after frame."""

    def __init__(self, options: Options, state: State) -> None:
        self.o, self.s, self.k = options, state, Kalman(options.size_noise)

    def _take(self, t: Track, box: np.ndarray, score: float, cls: int, again: bool) -> None:
        mean, cov = self.k.update(t.mean, t.cov, measure(box, self.o.size_noise))
        t.mean, t.cov, t.frame, t.state, t.active, t.score, t.cls = mean, cov, self.s.frame, TRACKED, True, float(score), int(cls)
        t.hits = 1 if again else t.hits + 1

    def _match(self, tracks: list[Track], rows: list[int], boxes: np.ndarray, scores: np.ndarray, classes: np.ndarray, most: float, fuse: bool) -> tuple[list[Track], list[int]]:
        cost = iou_cost(tracks, boxes[rows], self.o.size_noise)
        if fuse:
            cost = with_scores(cost, scores[rows])
        pairs, open_t, open_d = assign_within(cost, most) if cost.size else ([], list(range(len(tracks))), list(range(len(rows))))
        for i, j in pairs:
            d = rows[j]
            self._take(tracks[i], boxes[d], scores[d], classes[d], tracks[i].state == LOST)
        return [tracks[i] for i in open_t], [rows[j] for j in open_d]

    def update(self, boxes: np.ndarray, scores: np.ndarray, classes: np.ndarray, warp: np.ndarray | None = None) -> list[Track]:
        """One frame with at least one detection; returns the active tracks."""
        o, s = self.o, self.s
        s.frame += 1
        high = [i for i in range(len(scores)) if scores[i] > o.high]
        low = [i for i in range(len(scores)) if o.low < scores[i] <= o.high]
        fresh = [t for t in s.tracks if t.state == TRACKED and not t.active]
        known = [t for t in s.tracks if t.state == TRACKED and t.active]
        lost = [t for t in s.tracks if t.state == LOST]
        pool = known + lost
        if pool:
            means = np.array([t.mean for t in pool])
            means[[t.state != TRACKED for t in pool], 7] = 0
            for t, mean, cov in zip(pool, *self.k.predict_all(means, np.array([t.cov for t in pool]))):
                t.mean, t.cov = mean, cov
        if warp is not None:
            for t in pool + fresh:
                warped(t, warp)
        was_tracked = {id(t) for t in known}
        rest, high = self._match(pool, high, boxes, scores, classes, o.match, True)
        rest, _ = self._match([t for t in rest if id(t) in was_tracked], low, boxes, scores, classes, o.second, False)
        for t in rest:
            t.state = LOST
        unmet, high = self._match(fresh, high, boxes, scores, classes, o.unconfirmed, True)
        for t in unmet:
            t.state = REMOVED
        for i in high:
            if scores[i] >= o.new:
                mean, cov = self.k.start(measure(boxes[i], o.size_noise))
                s.tracks.append(Track(s.next_id, TRACKED, s.frame == 1, s.frame, s.frame, float(scores[i]), int(classes[i]), mean, cov))
                s.next_id += 1
        for t in s.tracks:
            if t.state == LOST and s.frame - t.frame > int(o.rate / 30.0 * o.buffer):
                t.state = REMOVED
        self._drop_doubles()
        s.tracks = [t for t in s.tracks if t.state != REMOVED]
        return [t for t in s.tracks if t.state == TRACKED and t.active]

    def _drop_doubles(self) -> None:
        """Of a tracked and a lost track in one place the longer-lived stays; of equals the lost one."""
        a, b = [t for t in self.s.tracks if t.state == TRACKED], [t for t in self.s.tracks if t.state == LOST]
        if a and b:
            cost = iou_cost(a, corners_of(b, self.o.size_noise), self.o.size_noise)
            for i, j in zip(*np.where(cost < 0.15)):
                older = a[i].frame - a[i].start > b[j].frame - b[j].start
                (b[j] if older else a[i]).state = REMOVED


OUTPUT = "stream_id bigint, frame_id bigint, track_id bigint, x1 double, y1 double, x2 double, y2 double, score double, cls int"
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


def frames(tracker: Tracker, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Runs a tracker over detections (frame_id, x1, y1, x2, y2, conf, cls) in frame order; frames at or before the last seen are rejected."""
    stream = rows["stream_id"].iloc[0] if len(rows) else 0
    frame, det = rows["frame_id"].to_numpy(), rows["det_id"].to_numpy()
    order = np.lexsort((det, frame))
    frame = frame[order]
    boxes = rows[["x1", "y1", "x2", "y2"]].to_numpy(float)[order]
    scores, classes = rows["conf"].to_numpy(float)[order], rows["cls"].to_numpy(int)[order]
    ends = np.flatnonzero(np.r_[True, frame[1:] != frame[:-1], True]) if len(frame) else np.zeros(1, int)
    out = []
    for low, high in zip(ends[:-1], ends[1:]):
        now = int(frame[low])
        if now <= tracker.s.seen:
            continue
        tracker.s.seen = now
        for t in tracker.update(boxes[low:high], scores[low:high], classes[low:high]):
            out.append((stream, now, t.track_id, *corners(t.mean, tracker.o.size_noise), t.score, t.cls))
    yield pd.DataFrame(out, columns=_COLUMNS)


def track(dets: DataFrame, options: Options | None = None) -> DataFrame:
    """Tracks of a table of detections (stream_id, frame_id, det_id, x1, y1, x2, y2, conf, cls), one stream a group."""
    o = options or Options()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return next(frames(Tracker(o, State()), rows))

    return dets.groupBy("stream_id").applyInPandas(run, OUTPUT)


def track_stream(dets: DataFrame, options: Options | None = None) -> DataFrame:
    """The same over a stream: the tracker's state is kept by stream between triggers."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    o = options or Options()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = State.load(state.get[0] if state.exists else None)
        rows = pd.concat(list(batches), ignore_index=True)
        yield from frames(Tracker(o, now), rows)
        state.update((now.dump(),))

    return dets.groupBy("stream_id").applyInPandasWithState(run, OUTPUT, "state string", "append", GroupStateTimeout.NoTimeout)


def sub(a: DataFrame, b: DataFrame, key: str = "track_id") -> DataFrame:
    """Tracks of ``a`` that aren't in ``b``."""
    return a.join(b.select(key).distinct(), key, "left_anti")


def joint(a: DataFrame, b: DataFrame, key: str = "track_id") -> DataFrame:
    """Tracks of ``a``, then those of ``b`` that aren't in it."""
    return a.unionByName(sub(b, a, key))


def removed_kept(removed: DataFrame, order: str, most: int = 999) -> DataFrame:
    """The last ``most`` removed tracks."""
    return removed.orderBy(F.desc(order)).limit(most)
