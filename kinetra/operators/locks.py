"""Locks that are carried from frame to frame: the anchor that is followed, and what touches it.

Both are state machines over the frames of a series in order. The boxes of a frame are gathered with it, so a job needs one exchange
by series; a series is the unit.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field
from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.operators.groups import grouped
from kinetra.operators.tracking import overlap

FRAME = ("series_id", "frame_id")


def _with_boxes(frames: DataFrame, boxes: DataFrame, columns: list[str]) -> DataFrame:
    """``frames`` with ``boxes``: the boxes of each frame in the order of ``box_id``."""
    listed = boxes.groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct("box_id", *columns))).alias("boxes"))
    return frames.join(listed, list(FRAME), "left")


def _corners(box: dict) -> tuple[float, ...]:
    return float(box["x1"]), float(box["y1"]), float(box["x2"]), float(box["y2"])


class Height:
    """A height and its speed under a Kalman filter that sees heights."""

    def __init__(self, value: float, drift: float = 0.01, noise: float = 0.1) -> None:
        self.x, self.v, self.a, self.b, self.c = value, 0.0, 1.0, 0.0, 1.0  # a, b, c: the covariance (a, b; b, c)
        self.drift, self.noise = drift, noise

    def see(self, value: float) -> None:
        g, h, off = self.a / (self.a + self.noise), self.b / (self.a + self.noise), value - self.x
        self.x, self.v = self.x + g * off, self.v + h * off
        self.a, self.b, self.c = self.a - g * self.a, self.b - g * self.b, self.c - h * self.b

    def go_on(self) -> float:
        """The height of the next frame."""
        self.x += self.v
        self.a, self.b, self.c = self.a + 2 * self.b + self.c + self.drift, self.b + self.c, self.c + self.drift
        return self.x


def anchor_lock(frames: DataFrame, anchors: DataFrame, fps: float = 30, least: float = 0.1, hold: float = 0.5) -> DataFrame:
    """``frames(series_id, frame_id, steady)`` with the followed box ``x1, y1, x2, y2``, ``seen`` and ``active``.

    Of the boxes ``anchors(series_id, frame_id, box_id, x1, y1, x2, y2, preferred)`` the one of best IoU (over ``least``) with the last one
    is followed; a preferred one takes its place once it was missed for more than ``hold`` seconds. The lock is active after a fifth of a second
    of boxes in a row and until two seconds without one, in which frames with a ``steady`` pose do not count. While it is active the box
    is the last one seen, from its lower edge up to a filtered height; otherwise it is null. A frame that is not listed is not counted.
    """
    patience, need, most = int(fps * hold), fps / 5, fps * 2

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held, unseen, last, height = None, 0, None, None
        streak = missed = 0
        active, out = False, []
        for steady, found in zip(rows["steady"], rows["boxes"], strict=True):
            found = [] if found is None else list(found)
            corners = [_corners(b) for b in found]
            chosen = None
            if held is not None:
                shared = [overlap(held, c) for c in corners]
                if shared and max(shared) > least:
                    chosen = corners[int(np.argmax(shared))]
                unseen = 0 if chosen is not None else unseen + 1
            if chosen is None and (held is None or unseen > patience):
                chosen = next((c for b, c in zip(found, corners, strict=True) if b["preferred"]), None)
                unseen = 0 if chosen is not None else unseen
            held = chosen if chosen is not None else held if unseen <= patience else None
            if chosen is not None:
                last, streak, missed = chosen, streak + 1, 0
                if not active and streak >= need:
                    active, height = True, Height(chosen[3] - chosen[1])
                if active:
                    height.see(chosen[3] - chosen[1])
            else:
                streak = 0
                missed += not (active and bool(steady))
                active = active and missed < most
            box = (last[0], last[3] - height.go_on(), last[2], last[3]) if active else (None,) * 4
            out.append((*box, chosen is not None, active))
        names = ["x1", "y1", "x2", "y2", "seen", "active"]
        return rows.drop(columns="boxes").reset_index(drop=True).join(pd.DataFrame(out, columns=names, index=range(len(rows))))

    nested = _with_boxes(frames, anchors, ["x1", "y1", "x2", "y2", "preferred"])
    empty = {c: F.lit(None).cast("double") for c in ("x1", "y1", "x2", "y2")} | {c: F.lit(False) for c in ("seen", "active")}
    return grouped(nested, ("series_id",), run, frames.withColumns(empty).schema, order=("frame_id",))


@dataclass(frozen=True)
class Rules:
    """What may touch the anchor: ``primary`` classes are locked on, ``fallback`` ones stand in, in order.

    ``height`` is where a class is measured, from its upper edge (0) to its lower one; ``weight`` what a stand-in counts against 1 for the
    locked box. Times are frames. A lock needs an IoU over ``contact`` with the anchor; stand-ins lie in the frame's ``person`` box within ``offset`` of
    the anchor's middle. Quality of a contact is half its IoU, three tenths its confidence and a bonus if it moved by a pixel.
    """

    primary: tuple[str, ...]
    fallback: tuple[str, ...] = ()
    height: dict[str, float] = field(default_factory=dict)
    weight: dict[str, float] = field(default_factory=dict)
    patience: int = 22
    fallback_patience: int = 15
    contact: float = 0.05
    offset: float = 224.0
    window: int = 10
    moving: float = 0.06
    other_weight: float = 0.05


class Contacts:
    """The locks of one series."""

    def __init__(self, rules: Rules) -> None:
        self.rules, self.locked, self.unseen = rules, None, 0
        self.stand_ins: dict[str, list[int]] = {}
        self.past: dict[str, deque] = {c: deque(maxlen=rules.window) for c in rules.fallback}
        self.centres: dict[int, tuple[float, float]] = {}
        self.value = 50.0

    def step(self, anchor: tuple[float, ...], reach: float, person: tuple[float, ...] | None, boxes: list[dict]) -> tuple[int | None, bool, list[int], int]:
        """Track of the locked box, whether it is hidden, tracks of the stand-ins, and the distance of the frame."""
        touching = [b for b in boxes if b["contact"]]
        active, hidden = self._locked(anchor, touching)
        if active is None:
            active, hidden = self._best(anchor, touching)
        others = [b for c in self.rules.fallback if (b := self._stand_in(c, anchor, person, boxes, active)) is not None]
        total = weights = 0.0
        if active is not None:
            total, weights = self._distance(anchor, reach, active), 1.0
        for b in others:
            if active is None or b["track_id"] != active["track_id"]:
                w = self.rules.weight.get(b["class_name"], self.rules.other_weight)
                total, weights = total + w * self._relative(anchor, b), weights + w
        if weights > 0:
            self.value = total / weights
        self.value = int(min(100, max(0, round(self.value))))
        for b in [*touching, *others]:
            if b["track_id"]:
                self.centres[b["track_id"]] = ((b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2)
        return None if active is None else active["track_id"], hidden, [b["track_id"] for b in others if b["track_id"] is not None], self.value

    def _locked(self, anchor: tuple[float, ...], touching: list[dict]) -> tuple[dict | None, bool]:
        """The box that is locked on, if it still touches; a weak touch hides it, a long absence ends the lock."""
        if self.locked is None:
            return None, False
        own = next((b for b in touching if b["track_id"] == self.locked), None)
        if own is not None and overlap(anchor, _corners(own)) > self.rules.contact:
            self.unseen = 0
            return own, False
        self.unseen += 1
        if own is None and self.unseen > self.rules.patience:
            self.locked = None
        return None, own is not None

    def _best(self, anchor: tuple[float, ...], touching: list[dict]) -> tuple[dict | None, bool]:
        """The primary contact of best quality; a new one takes the lock and is not hidden."""

        def quality(b: dict) -> float:
            was = self.centres.get(b["track_id"])
            moved = was is None or max(abs((b["x1"] + b["x2"]) / 2 - was[0]), abs((b["y1"] + b["y2"]) / 2 - was[1])) >= 1
            return 0.5 * overlap(anchor, _corners(b)) + 0.3 * b["confidence"] + self.rules.moving * moved

        primary = [b for b in touching if b["class_name"] in self.rules.primary]
        best = max(primary, key=quality, default=None)
        if best is None or best["track_id"] == self.locked:
            return best, True
        self.locked, self.unseen = best["track_id"], 0
        return best, False

    def _stand_in(self, name: str, anchor: tuple[float, ...], person: tuple[float, ...] | None, boxes: list[dict], active: dict | None) -> dict | None:
        """The stand-in of a class: the one that is held, or else the free aligned one, other than the locked box, nearest to the anchor's lower edge.

        One that is out of sight is held for a while and replaced meanwhile if another is there.
        """
        held = self.stand_ins.get(name)
        if held is not None:
            own = next((b for b in boxes if b["track_id"] == held[0]), None)
            held[1] = 0 if own is not None else held[1] + 1
            if own is not None:
                return own
            if held[1] > self.rules.fallback_patience:
                del self.stand_ins[name]
        if person is None:
            return None
        taken = {t for t, _ in self.stand_ins.values()}
        middle = (anchor[0] + anchor[2]) / 2
        free = []
        for b in boxes:
            cx, cy = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2
            inside = person[0] < cx < person[2] and person[1] < cy < person[3] and abs(cx - middle) < self.rules.offset
            if b["class_name"] == name and b is not active and inside and b["track_id"] not in taken:
                free.append((abs(cy - anchor[3]), b))
        if not free:
            return None
        new = min(free, key=lambda x: x[0])[1]
        self.stand_ins[name] = [new["track_id"], 0]
        return new

    def _distance(self, anchor: tuple[float, ...], reach: float, b: dict) -> float:
        at = b["y1"] + (b["y2"] - b["y1"]) * self.rules.height.get(b["class_name"], 0.5)
        return min(100.0, max(0.0, (anchor[3] - at) / reach * 100)) if reach > 0 else 50.0

    def _relative(self, anchor: tuple[float, ...], b: dict) -> float:
        """Where the median of the class's last distances lies between their least and largest, in per cent."""
        own = self.past[b["class_name"]]
        own.append(abs(anchor[3] - (b["y1"] + b["y2"]) / 2))
        if len(own) < 3:
            return min(100.0, own[-1] / 200 * 100)
        low, high = min(own), max(own)
        return (median(own) - low) / (high - low) * 100 if high > low else 50.0


def contact_lock(frames: DataFrame, boxes: DataFrame, rules: Rules) -> DataFrame:
    """``frames`` with ``track_id``, ``is_occluded``, ``contributors`` (tracks) and ``value``, the distance of what touches the anchor.

    ``frames(series_id, frame_id, active, x1, y1, x2, y2, reach, person)``: the anchor's box at full height, the distance that stands for
    100, and the box (an array) of the person, or null. ``boxes(series_id, frame_id, box_id, track_id, class_name, confidence, x1, y1, x2, y2, contact)``.
    A frame that is not active has the value 100 and nothing else, and leaves the locks as they are; without any contributor the value before stays.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        state, out = Contacts(rules), []
        for r in rows.itertuples(index=False):
            if not r.active or pd.isna(r.x1):
                out.append((None, False, [], 100))
                continue
            found = [] if r.boxes is None else list(r.boxes)
            person = None if r.person is None else tuple(map(float, r.person))
            out.append(state.step((r.x1, r.y1, r.x2, r.y2), float(r.reach), person, found))
        ids = pd.array([None if x[0] is None else int(x[0]) for x in out], dtype="Int64")
        done = rows.drop(columns="boxes").reset_index(drop=True)
        return done.assign(track_id=ids, is_occluded=[x[1] for x in out], contributors=[x[2] for x in out], value=[x[3] for x in out])

    columns = ["track_id", "class_name", "confidence", "x1", "y1", "x2", "y2", "contact"]
    new = {"track_id": F.lit(None).cast("long"), "is_occluded": F.lit(False), "contributors": F.array().cast("array<long>"), "value": F.lit(0)}
    return grouped(_with_boxes(frames, boxes, columns), ("series_id",), run, frames.withColumns(new).schema, order=("frame_id",))
