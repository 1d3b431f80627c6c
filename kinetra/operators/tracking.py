"""Boxes to tracks, frame by frame, one series in a task; of its boxes only those of a batch are held.

A track is tentative until it was seen often enough, then active; unseen for a while it is lost and may be identified again where it
was lost; the place of a loss is closed to new tracks for a moment. A track keeps the frame since which it counts as unseen, so what
becomes of it follows from the frame's number, and frames without boxes cost nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.operators.groups import dealt, whole_groups


@dataclass(frozen=True)
class Gates:
    """Thresholds of tracking, times in frames.

    ``iou`` of a box with its track (``iou_by_class`` for single classes); centres at most ``jump`` box sizes apart and both
    sides grown by a factor within ``sizes``; a track is lost when unseen for more than ``patience`` and forgotten after ``memory``; it is
    identified again within ``reid`` of its smaller side. ``confirm`` boxes make a track active, ``fade`` frames without one before end it.
    New tracks need ``confidence``, are ``new`` at most in a frame, and do not start with an IoU over ``closed_iou`` at a place where one
    of their class was lost up to ``closed`` frames before. Of active tracks of ``exclusive`` classes that overlap by more than ``overlap`` only the
    most confident stays.
    """

    iou: float = 0.5
    iou_by_class: dict[str, float] = field(default_factory=dict)
    exclusive: frozenset[str] = frozenset()
    jump: float = 1.5
    sizes: tuple[float, float] = (0.7, 1.3)
    patience: int = 45
    memory: int = 240
    reid: float = 0.75
    confirm: int = 2
    fade: int = 2
    confidence: float = 0.4
    new: int = 3
    closed: int = 15
    closed_iou: float = 0.5
    overlap: float = 0.3


def iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of boxes (x1, y1, x2, y2), broadcast over the leading axes; 0 where they do not meet."""
    w, h = (np.minimum(a[..., k + 2], b[..., k + 2]) - np.maximum(a[..., k], b[..., k]) for k in (0, 1))
    shared = np.where((w > 0) & (h > 0), w * h, 0.0)
    area = lambda x: (x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1])
    union = area(a) + area(b) - shared
    return np.divide(shared, union, out=np.zeros(np.shape(shared)), where=(shared > 0) & (union > 0))


def overlap(a: tuple[float, ...], b: tuple[float, ...]) -> float:
    """``iou`` of two boxes: for the few boxes of a frame plain numbers are faster than arrays."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if not (w > 0 and h > 0):
        return 0.0
    shared = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
    return shared / union if shared > 0 and union > 0 else 0.0


def _far(a: tuple[float, ...], b: tuple[float, ...]) -> float:
    return float(np.hypot((a[0] + a[2]) / 2 - (b[0] + b[2]) / 2, (a[1] + a[3]) / 2 - (b[1] + b[3]) / 2))


class Pools:
    """The tracks of one series by id: tentative, active and lost ones, each in the order in which they are served."""

    def __init__(self, gates: Gates) -> None:
        self.gates, self.ids = gates, 0
        self.tentative: dict[int, dict] = {}
        self.active: dict[int, dict] = {}
        self.lost: dict[int, dict] = {}
        self.closed: list[tuple[int, str, np.ndarray]] = []

    def step(self, frame: int, names: list[str], boxes: list[tuple[float, ...]], confidence: list[float]) -> list[tuple[int, str] | None]:
        """Track and state of each box of the frame, None for a box of no track."""
        g = self.gates
        out: list[tuple[int, str] | None] = [None] * len(names)
        free: dict[str, dict[int, tuple[float, ...]]] = {}
        for i, name in enumerate(names):
            free.setdefault(name, {})[i] = boxes[i]
        self._age(frame)

        def take(i: int, key: int, track: dict, state: str) -> None:
            track |= {"box": boxes[i], "confidence": confidence[i]}
            del free[names[i]][i]
            out[i] = (key, state)

        for key, track in self.active.items():
            last, least = track["box"], g.iou_by_class.get(track["class"], g.iou)
            best, most = None, -1.0
            for i, box in free.get(track["class"], {}).items():
                shared = overlap(box, last)
                if shared > least and shared > most and self._alike(box, last) and _far(box, last) <= g.jump * max(last[2] - last[0], last[3] - last[1]):
                    best, most = i, shared
            if best is not None:
                take(best, key, track, "active")
                track["since"] = frame
        for i in [i for i, name in enumerate(names) if i in free[name]]:
            near = {}
            for key, track in self.lost.items():
                last = track["box"]
                if track["class"] == names[i] and self._alike(boxes[i], last) and (far := _far(boxes[i], last)) <= g.reid * min(last[2] - last[0], last[3] - last[1]):
                    near[key] = far
            if near:
                key = min(near, key=near.get)
                self.active[key] = self.lost.pop(key)
                take(i, key, self.active[key], "active")
                self.active[key]["since"] = frame
        for key, track in list(self.tentative.items()):
            least = g.iou_by_class.get(track["class"], g.iou)
            i = next((i for i, box in free.get(track["class"], {}).items() if overlap(box, track["box"]) > least), None)
            if i is not None:
                track["seen"] += 1
                track["since"] += 1
                take(i, key, track, "tentative")
                if track["seen"] >= g.confirm:
                    self.active[key] = self.tentative.pop(key)
                    out[i] = (key, "active")
            elif frame - track["since"] > g.fade:
                del self.tentative[key]
        self._start(frame, names, boxes, confidence, free, out)
        self._exclude()
        return out

    def _alike(self, box: tuple[float, ...], last: tuple[float, ...]) -> bool:
        """Whether both sides grew by a factor within the limits; a track without a side matches nothing that has none."""
        low, high = self.gates.sizes
        grown = []
        for k in (0, 1):
            own, was = box[k + 2] - box[k], last[k + 2] - last[k]
            grown.append(own / was if was else math.nan if own == 0 else math.copysign(math.inf, own))
        return not any(map(math.isnan, grown)) and low <= min(grown) <= high

    def _age(self, frame: int) -> None:
        """What became of the tracks since the last frame: ``frame - since`` is how long each is unseen."""
        g = self.gates
        for key in [k for k, t in self.active.items() if frame - t["since"] > g.patience]:
            track = self.lost[key] = self.active.pop(key)
            self.closed.append((track["since"] + g.patience + 1, track["class"], track["box"]))
        self.lost = {k: t for k, t in self.lost.items() if frame - t["since"] < g.memory}
        self.closed = [c for c in self.closed if frame - c[0] <= g.closed]
        # frames before this one, which had no box for them
        self.tentative = {k: t for k, t in self.tentative.items() if frame - 1 - t["since"] <= g.fade}

    def _start(self, frame: int, names: list[str], boxes: list[tuple[float, ...]], confidence: list[float], free: dict[str, dict[int, tuple[float, ...]]], out: list) -> None:
        g, left = self.gates, self.gates.new
        for i in range(len(names)):
            if not left:
                return
            if i not in free[names[i]] or confidence[i] < g.confidence:
                continue
            if not any(name == names[i] and overlap(boxes[i], box) > g.closed_iou for _, name, box in self.closed):
                left, self.ids = left - 1, self.ids + 1
                self.tentative[self.ids] = {"class": names[i], "box": boxes[i], "confidence": confidence[i], "seen": 1, "since": frame}
                out[i] = (self.ids, "tentative")

    def _exclude(self) -> None:
        """Serve active tracks by confidence from now on, without those of exclusive classes that overlap a better one."""
        kept: dict[int, dict] = {}
        rivals: list[tuple[float, ...]] = []
        for key, track in sorted(self.active.items(), key=lambda x: -x[1]["confidence"]):
            alone = track["class"] in self.gates.exclusive
            if not alone or not any(overlap(x, track["box"]) > self.gates.overlap for x in rivals):
                kept[key] = track
                if alone:
                    rivals.append(track["box"])
        self.active = kept


def track_boxes(boxes: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """``boxes`` with ``track_id`` and ``state`` (tentative or active), null for a box that belongs to no track.

    Boxes of a frame are served in the order of ``box_id``; active tracks choose their best box by IoU, free boxes then the nearest lost
    track, and tentative tracks their first box. A box without a class or a number is of no track.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, pools = None, Pools(gates)
        for table, first in whole_groups(batches, ("series_id", "frame_id")):
            found: list[tuple[int, str] | None] = [None] * table.num_rows
            xy = np.stack([table.column(c).cast("double").to_numpy() for c in ("x1", "y1", "x2", "y2")], axis=1)
            confidence = table.column("confidence").cast("double").to_numpy()
            names, keys, frames = (table.column(c).to_pylist() for c in ("class_name", "series_id", "frame_id"))
            fine = np.isfinite(xy).all(axis=1) & np.isfinite(confidence) & ~table.column("class_name").is_null().to_numpy()
            fine, xy, confidence = fine.tolist(), list(map(tuple, xy.tolist())), confidence.tolist()
            for a, z in zip(first.tolist(), [*first[1:].tolist(), table.num_rows], strict=True):
                if (keys[a],) != series:
                    series, pools = (keys[a],), Pools(gates)
                at = [i for i in range(a, z) if fine[i]]
                if at and frames[a] is not None:
                    for i, x in zip(at, pools.step(frames[a], [names[i] for i in at], [xy[i] for i in at], [confidence[i] for i in at]), strict=True):
                        found[i] = x
            out = table.append_column("track_id", pa.array([None if x is None else x[0] for x in found], pa.int64()))
            yield from out.append_column("state", pa.array([None if x is None else x[1] for x in found], pa.string())).to_batches()

    schema = boxes.withColumns({"track_id": F.lit(None).cast("long"), "state": F.lit(None).cast("string")}).schema
    return dealt(boxes, ("series_id",), ("frame_id", F.asc_nulls_last("box_id"), F.asc_nulls_last("x1"))).mapInArrow(run, schema)
