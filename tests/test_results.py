"""Operators that SQL can't say easily, against results known by hand or found one by one."""

import math
import random
from statistics import median

import numpy as np
import pytest

from kinetra.operators import compound, editing, kernels, stats, tracking, tracks
from kinetra.streaming.steps import STEPS


def test_chapters_merge_adds_in_order(spark):
    r = random.Random(3)
    old = [(s, f"o{s}-{i}", a, a + r.randint(0, 9)) for s in range(6) for i, a in enumerate(range(0, 200, 50))]
    new = [(s, f"n{s}-{i}", a, a + r.randint(0, 25)) for s in range(6) for i, a in enumerate(r.sample(range(230), 15))]
    schema = "series_id long, chapter_id string, start_frame long, end_frame long"
    got = compound.chapters_merge(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()
    kept = list(old)
    for x in sorted(new, key=lambda x: (x[2], x[3], x[1])):
        if not any(x[0] == y[0] and max(x[2], y[2]) <= min(x[3], y[3]) for y in kept):
            kept.append(x)
    assert sorted(map(tuple, got)) == sorted(kept) and len(kept) > len(old)


def test_overlay_pairs_of_stored_frames(spark):
    """Frames that are stored one after the other, whatever their numbers, boxes of one class only."""
    r = random.Random(8)
    rows = [(s, f, k, r.choice("AB"), r.uniform(0, 60), r.uniform(0, 60)) for s in range(3) for f in (1, 2, 5, 9, 10) for k in range(8)]
    df = spark.createDataFrame([(*x, x[4] + 30, x[5] + 30) for x in rows], "series_id long, frame_id long, box_id long, class_name string, x1 double, y1 double, x2 double, y2 double")
    got = {(x.series_id, x.frame_id, x.a_id, x.b_id): x.iou for x in compound.overlay_pairs(df, 0.1).collect()}
    want = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[3] == b[3] and {1: 2, 2: 5, 5: 9, 9: 10}.get(a[1]) == b[1]:
                w, h = 30 - abs(a[4] - b[4]), 30 - abs(a[5] - b[5])
                v = w * h / (1800 - w * h) if w > 0 and h > 0 else 0
                if v >= 0.1:
                    want[a[0], a[1], a[2], b[2]] = v
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want) and want


def test_overlay_match_takes_the_best_pairs(spark):
    r = random.Random(4)
    rows = [(1, f, a, 10 + b, round(r.random(), 6)) for f in range(8) for a in range(5) for b in range(5) if r.random() < 0.7]
    got = compound.overlay_match(spark.createDataFrame(rows, "series_id long, frame_id long, a_id long, b_id long, iou double")).collect()
    want = set()
    for f in range(8):
        left = [x for x in rows if x[1] == f]
        while left:
            best = max(left, key=lambda x: x[4])
            want.add(best)
            left = [x for x in left if x[2] != best[2] and x[3] != best[3]]
    assert {tuple(x) for x in got} == want


def plain_tracks(frames, g):
    """The rules frame by frame over every frame number, counting unseen frames: box -> (track, state)."""

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h) if w > 0 and h > 0 else 0.0

    def apart(a, b):
        return math.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2)

    def size_fits(new, old):
        return g.sizes[0] <= min((new[2] - new[0]) / (old[2] - old[0]), (new[3] - new[1]) / (old[3] - old[1])) <= g.sizes[1]

    sides = lambda b: (b[2] - b[0], b[3] - b[1])
    limit = lambda c: g.iou_by_class.get(c, g.iou)
    out, tracks, dead, ids = {}, [], [], 0
    for f in range(min(frames), max(frames) + 1):
        todo = list(frames.get(f, []))
        for t in tracks:
            if t["pool"] == "active":
                t["unseen"] += 1
                if t["unseen"] > g.patience:
                    t["pool"] = "lost"
                    dead.append((f, t["cls"], t["box"]))
        dead = [d for d in dead if f - d[0] <= g.closed]
        lost = [t for t in tracks if t["pool"] == "lost"]
        for t in lost:
            t["unseen"] += 1
        tracks = [t for t in tracks if not (t["pool"] == "lost" and t["unseen"] > g.memory)]
        for t in [t for t in tracks if t["pool"] == "active"]:
            fit = [d for d in todo if d[1] == t["cls"] and iou(t["box"], d[2]) > limit(t["cls"]) and apart(t["box"], d[2]) <= g.jump * max(sides(t["box"])) and size_fits(d[2], t["box"])]
            if fit:
                d = max(fit, key=lambda d: iou(t["box"], d[2]))
                t.update(box=d[2], conf=d[3], unseen=0)
                todo.remove(d)
                out[d[0]] = (t["id"], "active")
        for d in list(todo):
            near = [t for t in sorted(tracks, key=lambda t: t.get("lost_at", 0)) if t["pool"] == "lost" and t["cls"] == d[1] and apart(t["box"], d[2]) <= g.reid * min(sides(t["box"])) and size_fits(d[2], t["box"])]
            if near:
                t = min(near, key=lambda t: apart(t["box"], d[2]))
                t.update(box=d[2], conf=d[3], unseen=0, pool="active")
                tracks.remove(t)
                tracks.append(t)
                todo.remove(d)
                out[d[0]] = (t["id"], "active")
        for t in [t for t in tracks if t["pool"] == "tentative"]:
            fit = [d for d in todo if d[1] == t["cls"] and iou(t["box"], d[2]) > limit(t["cls"])]
            if fit:
                t.update(box=fit[0][2], conf=fit[0][3], seen=t["seen"] + 1)
                todo.remove(fit[0])
                if t["seen"] >= g.confirm:
                    t["pool"] = "active"
                    tracks.remove(t)
                    tracks.append(t)
                out[fit[0][0]] = (t["id"], t["pool"])
            else:
                t["unseen"] += 1
                if t["unseen"] > g.fade:
                    tracks.remove(t)
        made = 0
        for d in todo:
            if made < g.new and d[3] >= g.confidence and not any(c == d[1] and iou(b, d[2]) > g.closed_iou for _, c, b in dead):
                ids, made = ids + 1, made + 1
                tracks.append({"id": ids, "cls": d[1], "box": d[2], "conf": d[3], "unseen": 0, "seen": 1, "pool": "tentative"})
                out[d[0]] = (ids, "tentative")
        kept, others = [], [t for t in tracks if t["pool"] != "active"]
        for t in sorted((t for t in tracks if t["pool"] == "active"), key=lambda t: -t["conf"]):
            if not (t["cls"] in g.exclusive and any(k["cls"] in g.exclusive and iou(k["box"], t["box"]) > g.overlap for k in kept)):
                kept.append(t)
        tracks = kept + others
    return out


@pytest.mark.parametrize("seed", range(6))
def test_tracks_against_plain_rules(spark, seed):
    """Random scenes: boxes that wander, vanish for short, long and very long, overlap across classes, and come back elsewhere."""
    r = random.Random(seed)
    g = tracking.Gates(iou_by_class={"B": 0.3}, exclusive=frozenset("AB"), patience=5, memory=30, closed=4, confirm=[2, 3][seed % 2], new=[3, 1][seed // 3])
    rows, n = [], 0
    for s in range(3):
        things = [[r.uniform(0, 150), r.uniform(0, 150), r.uniform(20, 40), r.choice("ABC")] for _ in range(7)]
        hidden = [0] * len(things)
        f = 0
        while f < 160:
            for k, x in enumerate(things):
                x[0], x[1], x[2] = x[0] + r.gauss(0, 2), x[1] + r.gauss(0, 2), max(8, x[2] * r.uniform(0.95, 1.05))
                if r.random() < 0.06:
                    hidden[k] = r.choice([1, 2, 4, 7, 12, 40])
                if hidden[k]:
                    hidden[k] -= 1
                    continue
                n += 1
                rows.append((s, f, x[3], x[0], x[1], x[0] + x[2], x[1] + x[2] * 1.2, r.choice([0.3, 0.5, 0.9, r.random()]), n))
            f += 1 if r.random() < 0.97 else r.choice([3, 8, 34])
    df = spark.createDataFrame(rows, "series_id long, frame_id long, class_name string, x1 double, y1 double, x2 double, y2 double, confidence double, box_id long")
    got = {x.box_id: (x.track_id, x.state) if x.track_id is not None else None for x in tracking.track_boxes(df, g).collect()}
    want = {}
    for s in range(3):
        frames = {}
        for x in rows:
            if x[0] == s:
                frames.setdefault(x[1], []).append((x[8], x[2], x[3:7], x[7]))
        want |= plain_tracks(frames, g)
    assert {k: v for k, v in got.items() if v} == want and len(got) == len(rows)
    assert len({v[0] for v in want.values()}) > 10 and {v[1] for v in want.values()} == {"tentative", "active"}


def test_tracks_of_broken_boxes(spark):
    rows = [(1, 0, None, 0.0, 0.0, 5.0, 5.0, 0.9, 1), (1, 0, "A", None, 0.0, 5.0, 5.0, 0.9, 2), (1, 0, "A", 3.0, 3.0, 3.0, 3.0, 0.9, 3), (1, 1, "A", 3.0, 3.0, 3.0, 3.0, 0.9, 4), (1, 2, "A", 0.0, 0.0, 5.0, 5.0, None, 5)]
    df = spark.createDataFrame(rows, "series_id long, frame_id long, class_name string, x1 double, y1 double, x2 double, y2 double, confidence double, box_id long")
    got = {x.box_id: x.track_id for x in tracking.track_boxes(df).collect()}
    assert got == {1: None, 2: None, 3: 1, 4: 2, 5: None} and tracking.track_boxes(df.limit(0)).count() == 0


def test_smoothed_tracks_lie_nearer_to_the_way(spark):
    r = np.random.default_rng(2)
    way = np.arange(60) * 3.0
    rows = [(1, 1, f, float(x + a - 10), float(a - 10), float(x + a + 10), float(a + 10)) for f, (x, a) in enumerate(zip(way, r.normal(0, 4, 60)))]
    short = [(1, 2, f, 0.0, 0.0, 5.0, 5.0 + f) for f in range(3)]
    df = spark.createDataFrame(rows + short, "series_id long, track_id long, frame_id long, x1 double, y1 double, x2 double, y2 double")
    got = compound.smooth_tracks(df).collect()
    assert sorted(tuple(x) for x in got if x.track_id == 2) == short
    off = lambda rows: np.mean([abs((x[3] + x[5]) / 2 - way[x[2]]) for x in rows if x[1] == 1])
    assert off(got) < 0.8 * off(rows)


def test_sizes_of_tracks_follow_slowly(spark):
    rows = [(1, 1, f * 3, 0.0, 0.0, 20.0 if f < 40 else 60.0, 20.0) for f in range(80)]
    df = spark.createDataFrame(rows, "series_id long, track_id long, frame_id long, x1 double, y1 double, x2 double, y2 double")
    fast, slow = ({x.frame_id: x.x2 - x.x1 for x in compound.smooth_tracks(df, lag=k).collect()} for k in (0, 30))
    w = fast[0]
    for f in sorted(fast)[1:]:
        w += 3 / 33 * (fast[f] - w)
        assert slow[f] == pytest.approx(w)
    assert fast[126] > 55 > 30 > slow[126] and all(abs(x.y2 - x.y1 - 20) < 1e-6 for x in compound.smooth_tracks(df).collect())


@pytest.mark.parametrize("block", [1 << 20, 1 << 9, 1 << 12])
def test_offset_against_all_differences(spark, monkeypatch, block):
    """The commonest difference of prominent extrema, at any lag, the least of equally common ones."""
    monkeypatch.setattr(stats, "LAG_BLOCK", block)
    r = random.Random(block)
    main, ref = [], []
    for s in range(12):
        n = r.choice([4, 12, 60, 200])
        times = sorted(r.sample(range(40_000), n))
        pos = [r.choice([0, 3, 50, 52, 52, 90, 100]) for _ in times]
        shift = r.choice([0, 7, -3000, 25_000])
        main += [(s, "stroke", t, p, i) for i, (t, p) in enumerate(zip(times, pos))]
        other = [(t + shift, p) for t, p in zip(times, pos) if t + shift >= 0 and r.random() < r.choice([0.6, 1])]
        ref += [(s, "stroke", t, p, i) for i, (t, p) in enumerate(other)]
    schema = "series_id long, axis string, at long, pos int, seq long"
    got = {x.series_id: (x.lag, x.hits) for x in stats.signal_offset(spark.createDataFrame(main, schema), spark.createDataFrame(ref, schema)).collect()}

    def prominent(rows):
        y, out = [x[3] for x in rows], []
        for sign in (1, -1):
            v = [sign * p for p in y]
            i = 0
            while i < len(v):
                j = i
                while j + 1 < len(v) and v[j + 1] == v[i]:
                    j += 1
                if 0 < i and j + 1 < len(v) and v[i - 1] < v[i] > v[j + 1]:
                    left, right = i, j
                    while left > 0 and v[left - 1] <= v[i]:
                        left -= 1
                    while right + 1 < len(v) and v[right + 1] <= v[i]:
                        right += 1
                    if v[i] - max(min(v[left : i + 1]), min(v[i : right + 1])) >= 5:
                        out.append((i + j) // 2)
                i = j + 1
        return [rows[k][2] for k in sorted(set(out))]

    want = {}
    for s in range(12):
        a, b = (prominent([x for x in rows if x[0] == s]) for rows in (main, ref))
        if len(a) >= 5 and len(b) >= 5:
            count = {}
            for x in a:
                for y in b:
                    count[x - y] = count.get(x - y, 0) + 1
            lag = min(count, key=lambda k: (-count[k], k))
            want[s] = (lag, count[lag])
    assert got == want and len(want) >= 5


@pytest.mark.parametrize(("persist", "history"), [(5, 20), (3, 12), (2, 60)])
def test_cells_frame_by_frame(spark, persist, history):
    """Countdowns and histories of cells that go from frame to frame."""
    from collections import deque

    r = random.Random(history)
    speed = {(y, x): r.choice([0.3, 0.7, 1.1]) for y in range(4) for x in range(5)}
    frames = {f: {c: (round(r.gauss(0, 1), 3), round(3 * math.sin(f * w + c[0]) + r.gauss(0, 0.5), 3), r.random() < 0.25) for c, w in speed.items()} for f in range(90)}
    timers, past, want = {}, {}, {}
    for f, own in frames.items():
        gx, gy = (median(v[k] for v in own.values()) for k in (0, 1))
        for c, v in own.items():
            if v[2]:
                timers[c] = persist
        timers = {c: n - 1 for c, n in timers.items() if n > 1}
        scored = {}
        for c in timers:
            dx, dy = own[c][0] - gx, own[c][1] - gy
            mine = past.setdefault(c, deque(maxlen=history))
            mine.append((dx, dy, math.hypot(dx, dy)))
            if len(mine) <= 10 or mine[-1][2] <= 0.2:
                continue
            ys = [m[1] for m in mine]
            sign = lambda v: (round(v, 9) > 0) - (round(v, 9) < 0)
            turns = sum(sign(a) != sign(b) for a, b in zip(ys, ys[1:]))
            five = [sum(ys[i : i + 5]) for i in range(len(ys) - 4)]
            hz = sum(sign(a) != sign(b) for a, b in zip(five, five[1:])) / 2 / 2.0
            mean = sum(m[2] for m in mine) / len(mine)
            if 0.5 <= hz <= 7:
                score = 0.7 * mean * (1 + turns / len(ys) * 10) * (1 + float(np.std(ys))) + 0.3 * mean * hz * math.exp(-((hz - 2.5) ** 2) / 4.5)
                if score > 0.5:
                    scored[c] = (score, dx, dy, mine[-1][2])
        near = lambda c: sum(o != c and abs(o[0] - c[0]) <= 1 and abs(o[1] - c[1]) <= 1 for o in scored)
        scored = {c: (v[0] * (1 + 0.2 * near(c)), *v[1:]) for c, v in scored.items()}
        kept = [v for v in scored.values() if v[0] > 0.6 * max(x[0] for x in scored.values())]
        if kept:
            lead, total = max(kept, key=lambda v: v[3]), sum(v[0] for v in kept)
            want[f] = (len(kept), *((lead[1], lead[2]) if len(kept) <= 2 else (sum(v[k] * v[0] for v in kept) / total for k in (1, 2))))
    rows = [(1, f, y, x, *v) for f, own in frames.items() for (y, x), v in own.items()]
    df = spark.createDataFrame(rows, "series_id long, frame_id long, row int, col int, dx double, dy double, hit boolean")
    got = {x.frame_id: (x.cells, x.dx, x.motion) for x in tracks.oscillation_cells(df, persist, history).collect()}
    assert set(got) == set(want) and len(want) > 20
    assert all(got[f] == pytest.approx(want[f]) for f in want)


def fitted(y, w, degree):
    """Least-squares values of windows of ``w`` points, those at the ends from the first and last window."""
    out = []
    for i in range(len(y)):
        a = min(max(i - w // 2, 0), len(y) - w)
        x = np.arange(w) - (i - a)
        out.append(np.polyval(np.polyfit(x, y[a : a + w], degree), 0))
    return np.round(out, 9)


def test_savgol_windows_against_fits(spark):
    r = random.Random(11)
    rows = []
    for s in range(12):
        n = [2, 3, 4, 9, 40][s % 5]
        rows += [(s, "stroke", t * 100, int(min(100, max(0, r.choice([0, 100, 50 + r.gauss(0, 40)])))), t) for t in range(n)]
    df = spark.createDataFrame(rows, "series_id long, axis string, at long, pos int, seq long")
    got = {(x.series_id, x.seq): x.pos for x in compound.savgol_unsaturated(df).collect()}
    other = {(x.series_id, x.seq): x.pos for x in compound.savgol_autotune(df, 9, 2).where("series_id % 5 = 4").collect()}
    for s in range(12):
        y = np.array([x[3] for x in rows if x[0] == s], dtype=float)
        tried = [(w, fitted(y, w, min(2, w - 1))) for w in range(3, min(15, len(y)) + 1, 2)]
        counts = [int(((v <= 1) | (v >= 99)).sum()) for _, v in tried]
        best = tried[counts.index(min(counts))][1] if tried else y
        want = np.clip(np.rint(best), 0, 100)
        assert [got[s, i] for i in range(len(y))] == want.tolist()
        if s % 5 == 4:
            whole = [np.clip(np.rint(fitted(y, w, 2)), 0, 100) for w in range(3, 10, 2)]
            ends = [int(((v <= 1) | (v >= 99)).sum()) for v in whole]
            inside = slice(4, len(y) - 4)
            assert [other[s, i] for i in range(len(y))][inside] in [v.tolist()[inside] for v in whole] and min(ends) >= 0


def test_add_batch_keeps_the_gap(spark):
    r = random.Random(6)
    points = [(1, "stroke", r.randrange(2000), r.randrange(100), i) for i in range(60)]
    new = [(1, "stroke", r.randrange(2000), r.randrange(100), 100 + i) for i in range(60)]
    schema = "series_id long, axis string, at long, pos int, seq long"
    got = sorted((x.at, x.pos, x.seq) for x in editing.add_batch(spark.createDataFrame(points, schema), spark.createDataFrame(new, schema), gap=25).collect())
    last = {}
    for _, _, at, pos, seq in sorted(points + new, key=lambda x: (x[2], x[4])):
        last[at] = (at, pos, seq)
    want = []
    for at in sorted(last):
        if not want or at - want[-1][0] >= 25:
            want.append(last[at])
    assert got == want


def test_recording_is_within_its_tolerance():
    r = np.random.default_rng(1)
    for _ in range(30):
        at = np.cumsum(r.integers(10, 90, 80))
        pos = np.clip(np.cumsum(r.integers(-9, 10, 80)) + 50, 0, 100)
        keep = kernels.recording_simplify(at, pos, 2.0)
        x = (at - at[0]) / (at[-1] - at[0]) * 100
        place = np.flatnonzero(keep)
        for a, z in zip(place, place[1:]):
            for i in range(a + 1, z):
                v, w = np.array([x[z] - x[a], pos[z] - pos[a]]), np.array([x[i] - x[a], pos[i] - pos[a]])
                along = min(1, max(0, (v @ w) / (v @ v)))
                assert np.hypot(*(w - along * v)) <= 2.0 + 1e-9


def test_visvalingam_drops_the_smallest_triangle_each_time():
    r = np.random.default_rng(3)
    for _ in range(30):
        at, pos = np.cumsum(r.integers(1, 9, 40)), r.integers(0, 101, 40)
        left = list(range(40))
        area = lambda a, i, z: abs((at[i] - at[a]) * (pos[z] - pos[a]) - (at[z] - at[a]) * (pos[i] - pos[a])) / 2  # noqa: B023, E731
        while len(left) > 2:
            cost = [area(*left[k - 1 : k + 2]) for k in range(1, len(left) - 1)]
            if min(cost) > 40:
                break
            del left[cost.index(min(cost)) + 1]
        keep = np.flatnonzero(kernels.visvalingam(at, pos, 40)).tolist()
        # equal areas may go in another order: what is left has no smaller one either way
        assert len(set(keep) ^ set(left)) <= 6 and all(area(*keep[k - 1 : k + 2]) > 40 for k in range(1, len(keep) - 1))


def test_steps_by_hand():
    lock = STEPS["lock"](fps=10)
    seen = [0, 1, 1, 0, 1] + [0] * 21 + [1, 1]
    want, run, lost, on = [], 0, 0, False
    for v in seen:
        run, lost = (run + 1, 0) if v else (0, lost + 1)
        on = run >= 2 or (on and lost <= 20)
        want.append(float(on))
    assert [lock.feed(0, v) for v in seen] == want and 0.0 in want[5:] and want[-1] == 1
    tick = STEPS["metronome"](bpm=60, swing=20)
    assert [t for t in range(0, 5000, 100) if tick.feed(t, 0) is not None] == [0, 1200, 2000, 3200, 4000]
    scale = STEPS["adaptive_scale"]()
    low, high, last = -0.2, 0.2, []
    r = random.Random(1)
    for _ in range(200):
        v = r.uniform(-1, 1)
        last = [*last, v][-5:]
        m = median(last)
        low, high = min(low * 0.995, m * (0.9 if m < -0.1 else 1.1)), max(high * 0.995, m * (1.1 if m > 0.1 else 0.9))
        a, z = min(low, -0.2), max(high, 0.2)
        part = min(1, max(-1, 2 * (m - a) / (z - a) - 1))
        assert scale.feed(0, v) == int(min(100, max(0, 50 + part * 40)))


def test_densify_shuffles_the_given_frames_only(spark):
    """Every frame of wide gaps, made behind the one exchange; null values and a second row of a frame."""
    rows = [(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 10_000, 3, None), (1, 10_003, 4, "c"), (2, 5, 1, None)]
    out = tracks.densify(spark.createDataFrame(rows, "series_id long, frame_id long, seq long, pose string"), "pose")
    got = {(x.series_id, x.frame_id): x.pose for x in out.collect()}
    assert got == {(1, f): "a" for f in range(10_003)} | {(1, 10_003): "c", (2, 5): None}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.index("Generate") < plan.index("Exchange")  # the plan prints the last step first


def test_dense_frames_take_little_disk(spark, tmp_path):
    """A file holds the frames of many series in less than a byte each, and all frames, of negative numbers too."""
    r = random.Random(6)
    given = {s: sorted({r.randrange(-3_000, 3_000) for _ in range(4)}) for s in range(200)}
    rows = [(s, f, i, r.choice("abcdef")) for s, own in given.items() for i, f in enumerate(own)]
    out = tracks.densify(spark.createDataFrame(rows, "series_id long, frame_id long, seq long, pose string"), "pose")
    out.write.parquet(str(tmp_path / "out"))
    told = {(s, f): p for s, f, _, p in rows}
    want = []
    for s, own in given.items():
        for f in range(own[0], own[-1] + 1):
            last = told.get((s, f), last if f > own[0] else None)
            want.append((s, f, last))
    assert sorted((x.series_id, x.frame_id, x.pose) for x in spark.read.parquet(str(tmp_path / "out")).collect()) == want
    assert sum(x.stat().st_size for x in (tmp_path / "out").glob("*.parquet")) < len(want)


def test_signal_offset_counts_few_pairs_without_blocks(monkeypatch):
    """Few pairs are counted one by one; both ways give the same lag."""
    r = random.Random(2)
    cases = [(np.array(sorted(r.sample(range(9_000), n))), np.array(sorted(r.sample(range(9_000), m)))) for n, m in ((5, 7), (40, 30), (90, 80))]
    monkeypatch.setattr(stats.np.fft, "rfft", None)
    few = [stats._correlation_peak(a, b) for a, b in cases]
    monkeypatch.undo()
    monkeypatch.setattr(stats, "LAG_BLOCK", 16)
    assert few == [stats._correlation_peak(a, b) for a, b in cases]


def test_smoothing_shares_gains_between_signals():
    """One pass for all signals of a track, as the matrices have it."""
    r = np.random.default_rng(5)
    t, z = np.cumsum(r.integers(0, 9, 40)), r.normal(50, 9, (4, 40))
    got = compound._rts(z, t, 1.0, 0.1)
    for own, y in zip(z, got, strict=True):
        x, p, told, seen = np.array([own[0], 0.0]), np.diag([1.0, 1.0]), [], []
        for i, v in enumerate(own):
            dt = float(t[i] - t[i - 1]) if i else 0.0
            f = np.array([[1, dt], [0, 1]])
            x, p = f @ x, f @ p @ f.T + 0.1 * np.array([[dt**3 / 3, dt**2 / 2], [dt**2 / 2, dt]])
            told.append((x, p, f))
            gain = p[:, 0] / (p[0, 0] + 1.0)
            x, p = x + gain * (v - x[0]), p - np.outer(gain, p[0])
            seen.append((x, p))
        want = [x]
        for (x, p), (x1, p1, f) in zip(seen[-2::-1], told[:0:-1], strict=True):
            want.append(x + p @ f.T @ np.linalg.inv(p1) @ (want[-1] - x1))
        assert np.allclose(y, [w[0] for w in want[::-1]], atol=1e-9)


def test_overlay_match_makes_no_frame_for_a_group(spark, monkeypatch):
    """One pass over sorted rows; a frame may go over the end of a batch, and a pair without an IoU comes last."""
    monkeypatch.setattr(compound, "grouped", None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rows = [(1, 1, 1, 1, 0.5), (1, 1, 1, 2, 0.9), (1, 1, 2, 2, 0.8), (1, 1, 2, 1, 0.3), (1, 2, 1, 1, 0.2), (1, 2, 1, 2, float("nan"))]
        got = compound.overlay_match(spark.createDataFrame(rows, "series_id long, frame_id long, a_id long, b_id long, iou double")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(tuple(x)[1:4] for x in got) == [(1, 1, 2), (1, 2, 1), (2, 1, 1)]


def test_segment_normalize_weighs_equal_neighbours_as_sql_does(spark):
    """The quantile of two equal values can lie just beside them, which decides which values are the middle."""
    import duckdb

    from kinetra.plans.q_tracks import segment_normalize  # noqa: F401 registers the SQL
    from kinetra.plans.base import ORACLES

    r = random.Random(7)
    groups = [[13, 13, 16, 18, 21, 28, 38, 42, 55, 100]] + [[r.choice([15, r.randint(0, 100)]) for _ in range(r.randint(1, 25))] for _ in range(200)]
    con = duckdb.connect()
    con.execute("CREATE TABLE events (user_id BIGINT, event_id BIGINT, ts BIGINT, value DOUBLE)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?)", [(u, i, i, v) for u, own in enumerate(groups) for i, v in enumerate(own)])
    want = {x[:2]: x[2] for x in con.execute(f"SELECT series_id, frame_id, out FROM ({ORACLES['segment_normalize']})").fetchall()}
    rows = [(u, i, 0, "busy", v) for u, own in enumerate(groups) for i, v in enumerate(own)]
    got = tracks.segment_normalize(spark.createDataFrame(rows, "series_id long, frame_id long, segment long, label string, value int"), ["idle"]).collect()
    assert {(x.series_id, x.frame_id): x.out for x in got} == want


def test_boxes_are_tracked_batch_by_batch(spark):
    """A series that goes over many Arrow batches is tracked as in one, and no batch needs a pandas frame of the whole."""
    assert not hasattr(tracking, "grouped")
    r = random.Random(9)
    rows = [(s, f, k, r.choice("RA"), r.uniform(0, 60), r.uniform(0, 60), r.random()) for s in range(3) for f in range(40) for k in range(r.randint(1, 5))]
    df = spark.createDataFrame([(*x[:6], x[4] + 30, x[5] + 30, x[6]) for x in rows], "series_id long, frame_id long, box_id long, class_name string, x1 double, y1 double, x2 double, y2 double, confidence double")
    once = sorted(map(str, tracking.track_boxes(df, tracking.Gates(iou=0.1)).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(str, tracking.track_boxes(df, tracking.Gates(iou=0.1)).collect())) == once
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_locks_measure_with_plain_numbers(monkeypatch):
    """The overlap of two boxes is that of the arrays, and a height's filter that of its matrices."""
    from kinetra.operators import locks

    r = random.Random(6)
    for _ in range(200):
        a, b = ([x, y, x + r.uniform(-1, 30), y + r.uniform(-1, 30)] for x, y in ((r.uniform(0, 40), r.uniform(0, 40)) for _ in range(2)))
        assert locks.overlap(tuple(a), tuple(b)) == float(tracking.iou(np.array(a), np.array(b)))
    own, x, p = locks.Height(100.0), np.array([100.0, 0.0]), np.eye(2)
    step = np.array([[1.0, 1.0], [0.0, 1.0]])
    for _ in range(50):
        z = r.uniform(50, 150)
        own.see(z)
        gain = p[:, 0] / (p[0, 0] + 0.1)
        x, p = x + gain * (z - x[0]), p - np.outer(gain, p[0])
        x, p = step @ x, step @ p @ step.T + 0.01 * np.eye(2)
        assert own.go_on() == pytest.approx(x[0], abs=1e-9)


def test_steady_beats_do_not_cost_their_square():
    """A section's median is kept while it grows: 40,000 steady beats are one section in a moment."""
    import time

    from kinetra.operators import beats

    began = time.perf_counter()
    assert beats.sections(np.full(40_000, 0.5)) == [(0, 40_000, 0.5)]
    assert time.perf_counter() - began < 5
    gaps = np.random.default_rng(4).choice([0.5, 0.55, 0.6, 1.2], 300)
    for a, z, usual in beats.sections(gaps):
        assert usual == float(np.median(gaps[a:z]))


def test_equal_anchors_go_by_their_place(spark):
    """Anchors that the order leaves equal: the one that stands first in the table, however the rows are dealt."""
    from pyspark.sql import functions as F

    rows = [(1, 1, 3, "R", 8.0, 40.0, 8.0 + w, 110.0, 0.5, place) for place, w in enumerate((40, 60, 20, 80))]
    schema = "series_id long, frame_id long, box_id long, class_name string, x1 double, y1 double, x2 double, y2 double, confidence double, place long"
    for own in (rows, rows[::-1]):
        got = tracks.detection_parse(spark.createDataFrame(own, schema).coalesce(1), "R", 480, F.col("place")).first()
        assert got.anchor_area == 40 * 70 / 480**2
