"""Locks against their rules, told frame by frame over random scenes."""

import random
from statistics import median

import numpy as np
import pytest

from kinetra.operators import locks

BOX = "series_id long, frame_id long, box_id long, track_id long, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h) if w > 0 and h > 0 else 0.0


def box_of(b):
    return tuple(b[k] for k in ("x1", "y1", "x2", "y2"))


@pytest.mark.parametrize("seed", range(4))
def test_anchor_lock(spark, seed):
    r = random.Random(seed)
    fps = r.choice([5, 10])
    frames, boxes = [], []
    for s in range(3):
        x, y, gone = 50.0, 50.0, 0
        for f in range(150):
            frames.append((s, f, r.random() < 0.5))
            x, y = x + r.gauss(0, 2), y + r.gauss(0, 2)
            gone = gone - 1 if gone else r.choice([0] * 12 + [1, 4, 9, 30])
            if gone == 0:
                boxes.append((s, f, 1, x, y, x + 20, y + 40 + r.gauss(0, 3), r.random() < 0.7))
            if r.random() < 0.2:
                boxes.append((s, f, 2, 200.0, 200.0, 230.0, 240.0 + f % 7, r.random() < 0.4))
    want = {}
    for s in range(3):
        lock, lost, run, miss, on, last, h, p = None, 0, 0, 0, False, None, None, None
        for _, f, steady in [x for x in frames if x[0] == s]:
            own = [x for x in boxes if x[:2] == (s, f)]
            pick = None
            if lock:
                best = max(own, key=lambda b: iou(lock, b[3:7]), default=None)
                if best and iou(lock, best[3:7]) > 0.1:
                    pick = lock = best[3:7]
                    lost = 0
                else:
                    lost += 1
            if not pick:
                better = [b for b in own if b[7]]
                if better and (not lock or lost > int(fps * 0.5)):
                    pick = lock = better[0][3:7]
                    lost = 0
            if lock and lost > int(fps * 0.5):
                lock = None
            if pick:
                last, run, miss = pick, run + 1, 0
                size = pick[3] - pick[1]
                if not on and run >= fps / 5:
                    on, h, p = True, np.array([size, 0.0]), np.eye(2)
                if on:
                    k = p @ np.array([1.0, 0.0]) / (p[0, 0] + 0.1)
                    h = h + k * (size - h[0])
                    p = (np.eye(2) - np.outer(k, [1.0, 0.0])) @ p
            else:
                run = 0
                if not (steady and on):
                    miss += 1
                if on and miss >= 2 * fps:
                    on = False
            if on:
                a = np.array([[1.0, 1.0], [0.0, 1.0]])
                h, p = a @ h, a @ p @ a.T + 0.01 * np.eye(2)
            want[s, f] = (on, pick is not None, (last[0], last[3] - h[0], last[2], last[3]) if on else None)
    df = spark.createDataFrame(frames, "series_id long, frame_id long, steady boolean")
    anchors = spark.createDataFrame(boxes, "series_id long, frame_id long, box_id long, x1 double, y1 double, x2 double, y2 double, preferred boolean")
    got = {(x.series_id, x.frame_id): x for x in locks.anchor_lock(df, anchors, fps).collect()}
    assert set(got) == set(want) and {x.active for x in got.values()} == {True, False}
    for k, (on, seen, box) in want.items():
        assert (got[k].active, got[k].seen) == (on, seen)
        assert (got[k].x1 is None) if box is None else (got[k].x1, got[k].y1, got[k].x2, got[k].y2) == pytest.approx(box)
    assert locks.anchor_lock(df.limit(0), anchors, fps).count() == 0


def plain_contacts(frames, boxes, u):
    """(track, hidden, stand-ins, value) of each frame of one series."""
    lock, away, extra, seen_at, history, last, out = None, 0, {}, {}, {}, 50, {}
    centre = lambda b: ((b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2)
    for fr in frames:
        if not fr["active"] or fr["x1"] is None:
            out[fr["frame_id"]] = (None, False, [], 100)
            continue
        a = box_of(fr)
        every = [b for b in boxes if b["frame_id"] == fr["frame_id"]]
        touch = [b for b in every if b["contact"]]
        act, hidden = None, False
        if lock is not None:
            same = [b for b in touch if b["track_id"] == lock]
            if same and iou(a, box_of(same[0])) > u.contact:
                act, away = same[0], 0
            elif same:
                away, hidden = away + 1, True
            else:
                away += 1
                if away > u.patience:
                    lock = None
        if act is None:
            hidden = True
            cands = [b for b in touch if b["class_name"] in u.primary]
            if cands:
                scores = []
                for b in cands:
                    before, now = seen_at.get(b["track_id"]), centre(b)
                    moves = before is None or abs(now[0] - before[0]) >= 1 or abs(now[1] - before[1]) >= 1
                    scores.append(iou(a, box_of(b)) * 0.5 + b["confidence"] * 0.3 + (u.moving if moves else 0))
                act = cands[scores.index(max(scores))]
                if act["track_id"] != lock:
                    lock, away, hidden = act["track_id"], 0, False
        helpers = []
        for c in u.fallback:
            found = None
            if c in extra:
                same = [b for b in every if b["track_id"] == extra[c][0]]
                if same:
                    found, extra[c] = same[0], (extra[c][0], 0)
                else:
                    extra[c] = (extra[c][0], extra[c][1] + 1)
                    if extra[c][1] > u.fallback_patience:
                        del extra[c]
            if found is None and fr["person"] is not None:
                held = {t for t, _ in extra.values()}
                p = fr["person"]
                near = [b for b in every if b is not act and b["class_name"] == c and b["track_id"] not in held and p[0] < centre(b)[0] < p[2] and p[1] < centre(b)[1] < p[3]]
                near = [b for b in near if abs(centre(b)[0] - (a[0] + a[2]) / 2) < u.offset]
                if near:
                    found = sorted(near, key=lambda b: abs(centre(b)[1] - a[3]))[0]
                    extra[c] = (found["track_id"], 0)
            if found is not None:
                helpers.append(found)
        parts = []
        if act is not None:
            at = act["y1"] + (act["y2"] - act["y1"]) * u.height.get(act["class_name"], 0.5)
            parts.append((min(100, max(0, (a[3] - at) / fr["reach"] * 100)) if fr["reach"] > 0 else 50, 1.0))
        for b in helpers:
            if act is None or b["track_id"] != act["track_id"]:
                h = history.setdefault(b["class_name"], [])
                h.append(abs(a[3] - centre(b)[1]))
                del h[: -u.window]
                v = min(100, h[-1] / 2) if len(h) < 3 else (median(h) - min(h)) / (max(h) - min(h)) * 100 if max(h) > min(h) else 50
                parts.append((v, u.weight.get(b["class_name"], u.other_weight)))
        value = sum(v * w for v, w in parts) / sum(w for _, w in parts) if parts else last
        last = int(min(100, max(0, round(value))))
        for b in touch + helpers:
            seen_at[b["track_id"]] = centre(b)
        out[fr["frame_id"]] = (act and act["track_id"], hidden, [b["track_id"] for b in helpers], last)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_contact_lock(spark, seed):
    r = random.Random(seed)
    rules = locks.Rules(primary=("N", "M"), fallback=("A", "B"), height={"N": 0.9}, weight={"A": 0.8}, patience=3, fallback_patience=2, contact=0.03, offset=r.choice([60.0, 300.0]))
    frames, boxes = [], []
    for s in range(3):
        things = [[k + 1, "NMABAB"[k % 6], r.uniform(20, 120), r.uniform(0, 150), 0] for k in range(9)]
        for f in range(120):
            person = None if r.random() < 0.15 else [0.0, 0.0, 180.0, 220.0]
            frames.append({"series_id": s, "frame_id": f, "active": r.random() < 0.9, "x1": None if r.random() < 0.03 else 60.0, "y1": 40.0, "x2": 100.0, "y2": 160.0, "reach": r.choice([120.0, 120.0, 0.0]), "person": person})
            for t in things:
                t[2], t[3] = t[2] + r.choice([0, 0, r.gauss(0, 3)]), t[3] + r.choice([0, 0, r.gauss(0, 5)])
                t[4] = t[4] - 1 if t[4] else r.choice([0] * 8 + [2, 5])
                if t[4] == 0:
                    boxes.append({"series_id": s, "frame_id": f, "box_id": t[0], "track_id": t[0], "class_name": t[1], "confidence": round(r.random(), 3), "x1": t[2], "y1": t[3], "x2": t[2] + 30, "y2": t[3] + 40, "contact": r.random() < 0.8})
    df = spark.createDataFrame(frames, "series_id long, frame_id long, active boolean, x1 double, y1 double, x2 double, y2 double, reach double, person array<double>")
    got = {(x.series_id, x.frame_id): (x.track_id, x.is_occluded, x.contributors, x.value) for x in locks.contact_lock(df, spark.createDataFrame(boxes, BOX + ", contact boolean"), rules).collect()}
    for s in range(3):
        want = plain_contacts([f for f in frames if f["series_id"] == s], [b for b in boxes if b["series_id"] == s], rules)
        assert {f: got[s, f] for f in want} == want
        assert len({w[0] for w in want.values()}) > 2 and {w[1] for w in want.values()} == {True, False}
