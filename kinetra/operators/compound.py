"""Operators made of several steps on one series: automatic tuning, matching, track smoothing, flow, beats."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetra.operators import kernels as K
from kinetra.operators.groups import Change, change_series, dealt, grouped
from kinetra.operators.joins import iou
from kinetra.operators.windows import reversal_peaks, savgol, savgol_weights
from kinetra.schema import KEY, series


def ultimate_autotune(
    df: DataFrame, scale: float = 1.2, centre: float = 50, speed: float = 800, jerk: float = 15, amplitude: float = 10, tolerance: float = 15
) -> DataFrame:
    """Drop speed artefacts, find anchors, amplify, take out jerk between anchors, simplify, thin lines, keep turns, round.

    A series of fewer than three points, or left with so few by the first step, stays as it is then.
    """

    def change(x: dict[str, np.ndarray]) -> Change:
        place, pos = K.tuned(x["at"], x["pos"], scale, centre, speed, jerk, amplitude, tolerance)
        return place, {"pos": pos}

    return change_series(df, change)


def savgol_autotune(df: DataFrame, longest: int = 9, degree: int = 3) -> DataFrame:
    """Smooth each series with the odd window that leaves the fewest points at 1 or under, or 99 or over; the shortest of equals."""
    rows = None
    for w in range(3, longest + 1, 2):
        if w > degree:
            one = savgol(df, w, degree).withColumn("_w", F.lit(w))
            rows = one if rows is None else rows.unionByName(one)
    ends = rows.groupBy(*KEY, "_w").agg(F.sum(((F.col("pos") <= 1) | (F.col("pos") >= 99)).cast("int")).alias("_n"))
    best = ends.groupBy(*KEY).agg(F.min(F.struct("_n", "_w")).alias("_b")).select(*KEY, F.col("_b._w").alias("_best"))
    return rows.join(best, list(KEY)).where("_w = _best").select(df.columns)


def savgol_unsaturated(df: DataFrame, low: float = 1, high: float = 99, longest: int = 15, degree: int = 2) -> DataFrame:
    """Smooth each series with the odd window, its length at most, that leaves the fewest unrounded values at ``low`` or under, or ``high`` or over.

    Windows are tried from three points on until one leaves none; of equals the shortest is taken. Short windows get a lower degree. A
    series of fewer than three points stays as it is.
    """

    def change(x: dict[str, np.ndarray]) -> Change:
        y, best = x["pos"].astype(float), None
        for w in range(3, min(longest, len(y)) + 1, 2):
            smooth = np.round(_savgol(y, w, min(degree, w - 1)), 9)
            left = int(((smooth <= low) | (smooth >= high)).sum())
            if best is None or left < best[0]:
                best = (left, smooth)
            if left == 0:
                break
        return None, {"pos": x["pos"] if best is None else np.clip(np.rint(best[1]), 0, 100).astype(np.int64)}

    return change_series(df, change)


def match_peaks(main: DataFrame, ref: DataFrame, window: float = 500, tolerance: float = 2) -> DataFrame:
    """Reversal peaks of ``main`` in order, each with the nearer of the two reference peaks next to it, if free and within
    ``window`` ms: ``(series_id, axis, kind, at, pos, ref_at, ref_pos, offset)``; unmatched ones of both sides too."""
    side = lambda df, k: reversal_peaks(df, tolerance).select(*KEY, "at", "pos", "seq", F.lit(k).alias("side"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "seq"], kind="stable")
        m, r = rows[rows["side"] == 0], rows[rows["side"] == 1]
        times, used, out = r["at"].to_numpy(), set(), []
        for at, pos in zip(m["at"].tolist(), m["pos"].tolist(), strict=True):
            k = int(np.searchsorted(times, at))
            free = [(abs(int(times[j]) - at), j) for j in (k - 1, k) if 0 <= j < len(times) and j not in used]
            gap, j = min(free, default=(window + 1, -1))
            if gap <= window:
                used.add(j)
                out.append(("matched", at, pos, int(times[j]), int(r["pos"].iloc[j]), float(gap)))
            else:
                out.append(("main", at, pos, None, None, None))
        out += [("ref", None, None, int(times[j]), int(r["pos"].iloc[j]), None) for j in range(len(times)) if j not in used]
        done = pd.DataFrame(out, columns=["kind", "at", "pos", "ref_at", "ref_pos", "offset"])
        done = done.astype({"at": "Int64", "pos": "Int32", "ref_at": "Int64", "ref_pos": "Int32", "offset": "Float64"})
        done.insert(0, "series_id", rows["series_id"].iloc[0])
        done.insert(1, "axis", rows["axis"].iloc[0])
        return done

    schema = "series_id long, axis string, kind string, at long, pos int, ref_at long, ref_pos int, offset double"
    return grouped(side(main, 0).unionByName(side(ref, 1)), KEY, run, schema)


def overlay_pairs(boxes: DataFrame, least: float = 0.1) -> DataFrame:
    """``(series_id, frame_id, a_id, b_id, iou)``: boxes of one class in a stored frame and the next one, with an IoU of ``least`` or more."""
    place = F.dense_rank().over(Window.partitionBy("series_id").orderBy("frame_id"))
    rows = boxes.where("class_name is not null").withColumn("_place", place)
    side = lambda df, p: df.select("series_id", "_place", "class_name", F.col("frame_id").alias(f"{p}frame"), *[F.col(c).alias(f"{p}{c}") for c in ("x1", "y1", "x2", "y2", "box_id")])
    met = side(rows, "a_").join(side(rows.withColumn("_place", F.col("_place") - 1), "b_"), ["series_id", "_place", "class_name"])
    found = met.select("series_id", F.col("a_frame").alias("frame_id"), F.col("a_box_id").alias("a_id"), F.col("b_box_id").alias("b_id"), F.round(iou("a_", "b_"), 9).alias("iou"))
    return found.where(F.col("iou") >= least)


def overlay_match(pairs: DataFrame) -> DataFrame:
    """Greedy best pairs of candidate rows ``(series_id, frame_id, a_id, b_id, iou)``: highest first, each box once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame, a, b = None, set(), set()
        for rows in batches:
            keep = []
            for *own, i, j in zip(*(rows.column(c).to_pylist() for c in ("series_id", "frame_id", "a_id", "b_id")), strict=True):
                if own != frame:
                    frame, a, b = own, set(), set()
                keep.append(i not in a and j not in b)
                if keep[-1]:
                    a.add(i)
                    b.add(j)
            yield rows.filter(pa.array(keep, pa.bool_()))

    best = F.desc_nulls_last(F.when(~F.isnan("iou"), F.col("iou")))
    return dealt(pairs, ("series_id", "frame_id"), (best, F.asc_nulls_last("a_id"), F.asc_nulls_last("b_id"))).mapInArrow(run, pairs.schema)


def chapters_merge(existing: DataFrame, incoming: DataFrame, mode: str = "merge") -> DataFrame:
    """``replace``, ``append``, or ``merge``: add each new chapter that meets neither an old nor an added one, in order."""
    cols = ["series_id", "chapter_id", "start_frame", "end_frame"]
    old, new = existing.select(cols), incoming.select(cols)
    if mode != "merge":
        return new if mode == "replace" else old.unionByName(new)
    meets = (F.col("series_id") == F.col("_s")) & (F.greatest("start_frame", "_a") <= F.least("end_frame", "_z"))
    taken = old.select(F.col("series_id").alias("_s"), F.col("start_frame").alias("_a"), F.col("end_frame").alias("_z"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["start_frame", "end_frame", "chapter_id"], kind="stable")
        end, keep = None, []
        for a, z in zip(rows["start_frame"].tolist(), rows["end_frame"].tolist(), strict=True):
            keep.append(end is None or a > end)
            end = z if keep[-1] else end
        return rows[keep]

    return old.unionByName(grouped(new.join(taken, meets, "left_anti"), ("series_id",), run, new.schema))


def stabilise(segments: list[list], fps: float, idle: str, merge: tuple[str, ...] = (), wins: str = "", inner: tuple[str, ...] = ()) -> list[list]:
    """Segments ``[start, end, label]`` merged until nothing changes, short ones absorbed, gaps filled with ``idle``.

    An idle gap under 10 s between equal labels closes; a segment of ``inner`` under 5 s between two of the
    same label of ``merge`` goes; neighbours of ``merge`` become ``wins``; equal neighbours join. Then what
    lasts under 10 s joins the neighbour labelled ``wins`` if only one is, else the longer one.
    """
    s = [list(x) for x in segments]
    last = lambda x: x[1] - x[0] + 1

    def joined(a: str, b: str) -> str | None:
        return wins if {a, b} <= set(merge) else a if a == b else None

    def join_neighbours(rows: list[list]) -> bool:
        changed, i = False, 0
        while i + 1 < len(rows):
            label = joined(rows[i][2], rows[i + 1][2])
            if label is None:
                i += 1
                continue
            rows[i][1:] = [rows[i + 1][1], label]
            del rows[i + 1]
            changed = True
        return changed

    changed = True
    while changed:
        changed = False
        for fits in (
            lambda a, b, c: a[2] == c[2] != idle == b[2] and last(b) < fps * 10,
            lambda a, b, c: a[2] == c[2] and a[2] in merge and b[2] in inner and last(b) < fps * 5,
        ):
            i = 0
            while i + 2 < len(s):
                if fits(*s[i : i + 3]):
                    s[i][1] = s[i + 2][1]
                    del s[i + 1 : i + 3]
                    changed = True
                else:
                    i += 1
        changed |= join_neighbours(s)
    i = 0
    while i < len(s) and len(s) > 1:
        if last(s[i]) >= int(fps * 10):
            i += 1
            continue
        before, after = (s[i - 1] if i else None), (s[i + 1] if i + 1 < len(s) else None)
        won = [x is not None and x[2] == wins for x in (before, after)]
        back = won[0] if won[0] != won[1] else before is not None and (after is None or last(before) >= last(after))
        if back:
            before[1] = s[i][1]
        else:
            after[0] = s[i][0]
        del s[i]
        i = 0
    out: list[list] = []
    for x in s:
        end = out[-1][1] if out else -1
        if x[0] > end + 1:
            out.append([end + 1, x[0] - 1, idle])
        out.append(x)
    join_neighbours(out)
    return out


def segments_stabilise(runs: DataFrame, fps: float, idle: str, merge: tuple[str, ...] = (), wins: str = "", inner: tuple[str, ...] = ()) -> DataFrame:
    """``stabilise`` on the runs ``(series_id, start_frame, end_frame, label)`` of each series."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start_frame", kind="stable")
        out = stabilise(rows[["start_frame", "end_frame", "label"]].to_numpy().tolist(), fps, idle, merge, wins, inner)
        a, z, label = zip(*out, strict=True)
        return pd.DataFrame({"series_id": rows["series_id"].iloc[0], "start_frame": a, "end_frame": z, "label": label})

    return grouped(runs, ("series_id",), run, "series_id long, start_frame long, end_frame long, label string")


def _rts(signals: np.ndarray, t: np.ndarray, noise: float, drift: float) -> np.ndarray:
    """Constant-velocity Kalman filter and the backward pass over it, for each row of ``signals``.

    Covariances and gains depend on the times alone, so all signals of a track share them; 2 x 2 matrices are written out.
    """
    gaps = [0.0, *np.diff(t).astype(float).tolist()]
    a, b, c = float(noise), 0.0, 1.0  # the covariance (a, b; b, c)
    gains, back = [], []
    for i, dt in enumerate(gaps):
        # a, b, c of the step before, then predicted
        pa, pb, pc = a + 2 * dt * b + dt * dt * c + drift * dt**3 / 3, b + dt * c + drift * dt**2 / 2, c + drift * dt
        if i:
            det = pa * pc - pb * pb
            if det > 1e-14 * pa * pc:
                inv = pc / det, -pb / det, pa / det
            else:
                inv = tuple(np.linalg.pinv(np.array([[pa, pb], [pb, pc]])).ravel()[[0, 1, 3]].tolist())
            u, v = a + dt * b, b + dt * c
            back.append((u * inv[0] + b * inv[1], u * inv[1] + b * inv[2], v * inv[0] + c * inv[1], v * inv[1] + c * inv[2]))
        g, h = pa / (pa + noise), pb / (pa + noise)
        gains.append((g, h))
        a, b, c = pa - g * pa, pb - g * pb, pc - h * pb
    out = []
    for z in signals.tolist():
        x, s = z[0], 0.0
        seen, told = [], []
        for value, dt, (g, h) in zip(z, gaps, gains, strict=True):
            x += dt * s
            told.append((x, s))
            off = value - x
            x, s = x + g * off, s + h * off
            seen.append((x, s))
        done = [x]
        for (x0, s0), (x1, s1), (k, m, n, o) in zip(reversed(seen[:-1]), reversed(told[1:]), reversed(back), strict=True):
            e, f = x - x1, s - s1
            x, s = x0 + k * e + m * f, s0 + n * e + o * f
            done.append(x)
        out.append(done[::-1])
    return np.array(out)


def _lagged(sizes: np.ndarray, frames: np.ndarray, lag: float) -> np.ndarray:
    """Each size drawn to by its gap in frames against the gap and ``lag`` together, from the size before it."""
    out, gaps = sizes.tolist(), np.maximum(np.diff(frames), 1).tolist()
    for i, dt in enumerate(gaps, 1):
        out[i] = out[i - 1] + dt / (lag + dt) * (out[i] - out[i - 1])
    return np.array(out)


def smooth_tracks(boxes: DataFrame, noise: float = 1.0, drift: float = 0.1, least: int = 5, lag: int = 30) -> DataFrame:
    """Centres and sizes of every track smoothed forward and backward; sizes then follow slowly, over about ``lag`` frames (0: at once).

    Tracks under ``least`` boxes stay as they are.
    """

    def change(rows: dict[str, np.ndarray]) -> Change:
        t = rows["frame_id"]
        if len(t) < least:
            return None, {c: rows[c] for c in corners}
        x1, y1, x2, y2 = (rows[c].astype(float) for c in corners)
        cx, cy, w, h = _rts(np.stack([(x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1]), t, noise, drift)
        w, h = (_lagged(np.maximum(z, 1), t, lag) for z in (w, h))
        return None, {"x1": cx - w / 2, "y1": cy - h / 2, "x2": cx + w / 2, "y2": cy + h / 2}

    corners = ("x1", "y1", "x2", "y2")
    return change_series(boxes, change, ("frame_id", *corners), ("series_id", "track_id"), ("frame_id",))


def _savgol(y: np.ndarray, window: int, degree: int) -> np.ndarray:
    window = min(window, len(y) - (len(y) + 1) % 2)
    if window <= degree:
        return y
    w, half = savgol_weights(window, degree), window // 2
    out = np.convolve(y, w[half][::-1], "same")
    out[:half], out[len(y) - half :] = w[:half] @ y[:window], w[half + 1 :] @ y[-window:]
    return out


def flow_position(dy: np.ndarray, fps: float, low: float = 0, high: float = 100) -> np.ndarray:
    """Motion to position: median of five, sum, less its slow trend (3 s), smoothed, 5th to 95th percentile to the range."""
    wide = np.pad(dy.astype(float), 2, mode="symmetric") if len(dy) >= 2 else np.repeat(dy, 5).astype(float)
    y = -np.cumsum(np.median(np.lib.stride_tricks.sliding_window_view(wide, 5), axis=1))
    y = _savgol(y - _savgol(y, int(fps * 3) | 1, 2), 7, 2)
    p5, p95 = np.percentile(y, (5, 95))
    if p95 - p5 < 1e-9:
        return np.full(len(y), (low + high) / 2)
    return np.clip(low + (y - p5) / (p95 - p5) * (high - low), 0, 100)


def flow_to_position(signal: DataFrame, fps: float = 30, prominence: float = 4) -> DataFrame:
    """Points at the peaks and valleys of ``flow_position`` of each series ``(series_id, frame_id, dy)``, and at its ends."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame_id", kind="stable")
        y = flow_position(rows["dy"].to_numpy(float), fps)
        limits = {"prominence": prominence, "distance": max(1.0, 0.25 * fps)}
        place = np.unique(np.concatenate([[0, len(y) - 1], K.find_peaks(y, **limits), K.find_peaks(-y, **limits)]).astype(int))
        frame = rows["frame_id"].to_numpy()[place]
        return pd.DataFrame({"series_id": rows["series_id"].iloc[0], "at": np.rint(frame / fps * 1000).astype("int64"), "pos": np.rint(y[place]).astype("int32")})

    return grouped(signal, ("series_id",), run, "series_id long, at long, pos int")


def energy_envelope(samples: DataFrame, hop: int = 8, smooth: int = 5) -> DataFrame:
    """RMS of every ``hop`` samples ``(series_id, i, value)``, moving average mirrored at both ends, over its 99th percentile."""
    rms = samples.groupBy("series_id", F.floor(F.col("i") / hop).cast("long").alias("hop")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("e"))
    rms = rms.withColumns({"n": F.row_number().over(Window.partitionBy("series_id").orderBy("hop")), "c": F.count("*").over(Window.partitionBy("series_id"))})
    half = smooth // 2
    # copies of the rows near an end stand for what lies beyond it
    mirrored = F.array(F.col("n"), F.when(F.col("n") <= half, 1 - F.col("n")), F.when(F.col("c") - F.col("n") < half, 2 * F.col("c") + 1 - F.col("n")))
    wide = rms.select("series_id", "hop", "e", F.posexplode(mirrored).alias("copy", "m")).where("m is not null")
    near = Window.partitionBy("series_id").orderBy("m").rangeBetween(-half, half)
    out = wide.withColumn("s", F.sum("e").over(near) / smooth).where("copy = 0")
    out = out.withColumn("_p", F.percentile("s", 0.99).over(Window.partitionBy("series_id")))
    return out.select("series_id", "hop", F.when(F.col("_p") > 0, F.least(F.lit(1.0), F.col("s") / F.col("_p"))).otherwise(F.lit(0.0)).alias("energy"))


def beat_lines(series_ids: DataFrame, bpm: float, subdivision: int, end_ms: int, per_bar: int = 4) -> DataFrame:
    """Grid times of each series with their level: downbeat, quarter or sub."""
    step = 60000.0 / bpm / subdivision
    rows = series_ids.select("series_id", F.explode(F.sequence(F.lit(0), F.lit(int(end_ms / step)))).alias("k"))
    level = F.when(F.col("k") % (subdivision * per_bar) == 0, "downbeat").when(F.col("k") % subdivision == 0, "quarter").otherwise("sub")
    return rows.select("series_id", "k", (F.col("k") * step).alias("t"), level.alias("level"))


def tap_tempo(taps: DataFrame, pause_ms: int = 3000, last: int = 16) -> DataFrame:
    """``bpm`` at each tap from the mean interval of the last taps since a pause; null at the first."""
    rows = taps.withColumn("_g", F.col("at") - F.lag("at").over(series()))
    rows = rows.withColumn("_new", F.coalesce((F.col("_g") > pause_ms).cast("int"), F.lit(1)))
    rows = rows.withColumn("session", F.sum("_new").over(series()))
    w = Window.partitionBy(*KEY, "session").orderBy("at", "seq").rowsBetween(-(last - 2), 0)
    mean = F.avg(F.when(F.col("_new") == 0, F.col("_g"))).over(w)
    return rows.withColumn("bpm", F.when(mean > 0, 60000 / mean)).drop("_g", "_new")


#: Fixed values of the test signal: axis, frequency (Hz), phase, amplitude.
SINES = (
    ("stroke", 0.5, 0.0, 50),
    ("roll", 0.3, math.pi / 4, 35),
    ("pitch", 0.25, math.pi / 2, 30),
    ("twist", 0.4, math.pi, 25),
    ("sway", 0.15, math.pi / 3, 20),
    ("surge", 0.2, math.pi / 6, 15),
)


def generate_sines(series_ids: DataFrame, end_ms: int, step: int = 100) -> DataFrame:
    """Six sine axes of every series, a point each ``step`` ms."""
    wave = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(f).alias("f"), F.lit(p).alias("p"), F.lit(m).alias("m")) for a, f, p, m in SINES]))
    rows = series_ids.select("series_id", wave.alias("w")).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(end_ms), F.lit(step))))
    y = 50 + F.col("w.m") * F.sin(2 * math.pi * F.col("w.f") * F.col("at") / 1000 + F.col("w.p"))
    return rows.select("series_id", "w.axis", F.col("at").cast("long").alias("at"), F.least(F.greatest(F.rint(F.round(y, 6)), F.lit(0)), F.lit(100)).cast("int").alias("pos"))
