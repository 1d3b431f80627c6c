"""Series and chapters derived from others: further axes, repeated cycles, onsets, labels that persist, chapters from votes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetra.operators import kernels as K
from kinetra.operators.editing import label_runs, majority_vote
from kinetra.operators.groups import grouped
from kinetra.operators.sequential import per_series
from kinetra.operators.tracks import pose_dissimilarity
from kinetra.schema import KEY


def moving_average(x: np.ndarray, size: int) -> np.ndarray:
    """Mean of ``size`` values around each (one more before than after if even), the ends mirrored with their value."""
    if not len(x):
        return x
    before, after = size // 2, size - size // 2 - 1
    place = np.arange(-before, len(x) + after) % (2 * len(x))
    wide = np.concatenate([x, x[::-1]])[place]
    total = np.concatenate([[0.0], np.cumsum(wide)])
    return (total[size:] - total[:-size]) / size


def generated_axis(at: np.ndarray, pos: np.ndarray, axis: str, intensity: float = 1, smoothing: float = 5, seed: int = 42) -> np.ndarray:
    """An axis around 50 from a primary one: roll follows the direction, pitch the acceleration, sway the slow movement,
    surge the speed's envelope, twist a seeded walk in steps of the speed."""
    dt = np.diff(at).astype(float)
    v = np.diff(pos) / np.where(dt > 0, dt, 1.0)
    v = np.append(v, v[-1])
    size = lambda k: max(3, int(smoothing * k))
    unit = lambda x, s: x / s if s > 0 else x
    if axis == "roll":
        y = moving_average(np.sign(v), size(2)) * 40
    elif axis == "pitch":
        a = np.diff(v)
        a = moving_average(np.append(a, a[-1]), size(3))
        y = np.clip(unit(a, a.std() * 3), -1, 1) * 40
    elif axis == "sway":
        x = moving_average(pos.astype(float), size(5))
        x = x - x.mean()
        y = unit(x, np.abs(x).max()) * 30
    elif axis == "surge":
        reach = size(3)
        wide = np.concatenate([np.zeros(reach), np.abs(v)])
        top = moving_average(np.lib.stride_tricks.sliding_window_view(wide, reach + 1).max(axis=1), size(2))
        y = (unit(top, top.max()) - 0.5) * 60
    elif axis == "twist":
        speed = np.abs(v)
        walk = np.cumsum(np.random.default_rng(seed).normal(size=len(v)) * speed / (speed.max() + 1e-6) * 0.3)
        walk = moving_average(walk - moving_average(walk, max(3, len(walk) // 4)), size(2))
        y = np.clip(unit(walk, walk.std() * 2.5), -1, 1) * 35
    else:
        raise ValueError(f"no rule for the axis {axis}")
    return 50 + y * intensity


def axis_generate(points: DataFrame, target: str, source: str = "stroke", intensity: float = 1, smoothing: float = 5, phase_ms: int = 0) -> DataFrame:
    """Points of the target axis for every series of the source axis that has four points or more."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) < 4:
            return rows.iloc[:0]
        at = rows["at"].to_numpy()
        y = generated_axis(at, rows["pos"].to_numpy(), target, intensity, smoothing)
        return rows.assign(axis=target, at=np.clip(at + phase_ms, 0, at[-1]), pos=np.clip(np.rint(y), 0, 100).astype("int32"))

    return per_series(points.where(F.col("axis") == source), run)


def axis_from_pose(angles: DataFrame, target: str, intensity: float = 1, smoothing: float = 5, phase_ms: int = 0) -> DataFrame:
    """Points from positions of a pose angle ``(series_id, axis, at, pos, seq)``: smoothed, scaled around 50, shifted."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) < 4:
            return rows.iloc[:0]
        at = rows["at"].to_numpy()
        y = 50 + (moving_average(rows["pos"].to_numpy(float), max(3, int(smoothing * 2))) - 50) * intensity
        return rows.assign(axis=target, at=np.clip(at + phase_ms, 0, at[-1]), pos=np.clip(np.rint(y), 0, 100).astype("int32"))

    return per_series(angles, run)


def repeated(at: np.ndarray, pos: np.ndarray, selected: np.ndarray, keep_valleys: bool) -> list[tuple[int, int]]:
    """Points with the cycle before the selection put into each selected peak-to-peak stretch.

    The cycle runs back from the first selected point to the last point of the same position. It replaces the
    valley of a stretch, or is scaled to it in two halves.
    """
    same = list(zip(at.tolist(), pos.tolist(), strict=True))
    chosen = np.flatnonzero(selected)
    if len(at) < 6 or not len(chosen) or chosen[0] < 2:
        return same
    end = int(chosen[0])
    back = [i for i in range(end - 2, -1, -1) if pos[i] == pos[end]]
    if not back:
        return same
    start = back[0]
    low = start + int(np.argmin(pos[start:end][::-1]))
    low = end - 1 - (low - start)
    gone, new = set(), []

    def put(a: int, z: int, t: tuple[int, int], p: tuple[int, int] | None) -> None:
        """Points strictly between places a and z of the cycle, stretched to times t and positions p."""
        if at[z] <= at[a]:
            return
        for i in range(a + 1, z):
            time = t[0] + (t[1] - t[0]) / (at[z] - at[a]) * (at[i] - at[a])
            value = float(pos[i])
            if p is not None:
                span = pos[z] - pos[a]
                value = p[0] + ((p[1] - p[0]) / max(1, span) if span else 0) * (pos[i] - pos[a])
            new.append((int(round(float(time))), int(min(100, max(0, round(value))))))

    for i in chosen.tolist():
        if i + 4 >= len(at):
            break
        if not (i > 0 and pos[i] > pos[i - 1] and pos[i] > pos[i + 1] and pos[i + 2] > pos[i + 1] and pos[i + 2] > pos[i + 3]):
            continue
        if keep_valleys:
            put(start, low, (at[i], at[i + 1]), (pos[i], pos[i + 1]))
            put(low, end, (at[i + 1], at[i + 2]), (pos[i + 1], pos[i + 2]))
        else:
            gone.add(i + 1)
            put(start, end, (at[i], at[i + 2]), None)
    return sorted([x for i, x in enumerate(same) if i not in gone] + new, key=lambda x: x[0])


def repeat_pattern(points: DataFrame, start_ms: int, keep_valleys: bool = False) -> DataFrame:
    """``repeated`` for the points from ``start_ms`` on; rows ``(series_id, axis, at, pos)``."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "seq"], kind="stable")
        at = rows["at"].to_numpy()
        out = repeated(at, rows["pos"].to_numpy(), at >= start_ms, keep_valleys)
        return pd.DataFrame({"series_id": rows["series_id"].iloc[0], "axis": rows["axis"].iloc[0], "at": [t for t, _ in out], "pos": [p for _, p in out]})

    return grouped(points, KEY, run, "series_id long, axis string, at long, pos int")


def onsets(samples: np.ndarray, rate: float, window: int = 1024, hop: int = 256, sensitivity: float = 1.0, gap_s: float = 0.1) -> np.ndarray:
    """Times (s) of peaks of the spectral flux over its mean plus ``sensitivity`` deviations."""
    if len(samples) < window + hop:
        return np.zeros(0)
    frames = np.lib.stride_tricks.sliding_window_view(samples, window)[::hop]
    spectrum = np.abs(np.fft.rfft(frames * np.hanning(window), axis=1))
    flux = np.append(0.0, np.maximum(np.diff(spectrum, axis=0), 0).sum(axis=1))
    if flux.max() == 0:
        return np.zeros(0)
    flux = flux / flux.max()
    return K.find_peaks(flux, height=flux.mean() + sensitivity * flux.std(), distance=max(1, int(gap_s * rate / hop))) * hop / rate


def onset_flux(samples: DataFrame, rate: float, window: int = 1024, hop: int = 256, sensitivity: float = 1.0, gap_s: float = 0.1) -> DataFrame:
    """Onset times of each series of ``samples(series_id, i, value)``."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        t = onsets(rows.sort_values("i")["value"].to_numpy(float), rate, window, hop, sensitivity, gap_s)
        return pd.DataFrame({"series_id": np.full(len(t), rows["series_id"].iloc[0]), "t": t})

    return grouped(samples, ("series_id",), run, "series_id long, t double")


def label_weak(boxes: DataFrame, priority: dict[str, tuple[int, str]], first: tuple[str, ...], height: float, none: str) -> DataFrame:
    """Label of frames without an anchor: a class of ``first`` by priority and area, else the best of priority times
    (1 + share of the frame in per cent); ``none`` without a known class."""
    rank = F.create_map(*[F.lit(x) for k, (p, _) in priority.items() for x in (k, p)])
    name = F.create_map(*[F.lit(x) for k, (_, n) in priority.items() for x in (k, n)])
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    rows = boxes.withColumns({"_p": F.try_element_at(rank, F.col("class_name")), "_area": area, "_first": F.col("class_name").isin(*first)})
    score = F.when(F.col("_p").isNotNull(), F.struct(F.col("_first").alias("f"), F.when(F.col("_first"), F.col("_p").cast("double")).otherwise(F.col("_p") * (1 + F.col("_area") / height**2 * 100)).alias("s"), F.col("_area").alias("a"), F.col("class_name").alias("c")))
    best = rows.groupBy("series_id", "frame_id").agg(F.max(score).alias("b"))
    return best.select("series_id", "frame_id", F.coalesce(F.try_element_at(name, F.col("b.c")), F.lit(none)).alias("label"))


def label_persistence(frames: DataFrame, idle: str, zones: dict[str, list[int]], limit: float = 2.5) -> DataFrame:
    """Frames ``(series_id, frame_id, label, pose, area)`` in which an idle label takes the last good one, while the pose stays near.

    The last known pose is held against that at the last good label by ``pose_dissimilarity`` over the keypoints (from 0) that
    ``zones`` names for the label; a label without a zone does not last. Null poses keep the one before.
    """
    order = Window.partitionBy("series_id").orderBy("frame_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = frames.withColumn("_pose", F.last(F.when(F.col("pose").isNotNull(), F.struct("pose", "area")), ignorenulls=True).over(upto))
    rows = rows.withColumn("_good", F.last(F.when(F.col("label") != idle, F.struct(F.col("label").alias("label"), F.col("_pose.pose").alias("pose"))), ignorenulls=True).over(upto))
    places = F.try_element_at(F.create_map(*[F.lit(x) for k, v in zones.items() for x in (k, v)]), F.col("_good.label")) if zones else F.lit(None).cast("array<int>")
    part = lambda pose: F.transform(places, lambda i: F.get(pose, i))
    apart = pose_dissimilarity(part(F.col("_pose.pose")), part(F.col("_good.pose")), F.col("_pose.area"))
    known = (F.col("label") == idle) & F.col("_good.pose").isNotNull() & places.isNotNull()
    return rows.withColumn("label", F.when(known & (apart < limit), F.col("_good.label")).otherwise(F.col("label"))).select(frames.columns)


def built(runs: list[list], fps: float, idle: tuple[str, ...], short_s: float = 20, gap_s: float = 20, absorb_s: float = 30) -> list[list]:
    """Chapters ``[start, end, label]`` from runs: short ones join the one before, equal ones near each other join, idle
    ones under ``absorb_s`` between active ones join the longer of these."""
    out: list[list] = []
    for a, z, label in runs:
        if out and z - a < int(short_s * fps):
            out[-1][1] = z
        else:
            out.append([a, z, label])
    s, out = out, []
    for x in s:
        if out and out[-1][2] == x[2] and x[0] - out[-1][1] < int(gap_s * fps):
            out[-1][1] = x[1]
        else:
            out.append(x)
    changed = True
    while changed:
        changed = False
        for i in range(1, len(out) - 1):
            a, x, z = out[i - 1 : i + 2]
            if x[2] in idle and a[2] not in idle and z[2] not in idle and x[1] - x[0] < int(absorb_s * fps):
                if a[1] - a[0] >= z[1] - z[0]:
                    a[1] = x[1]
                else:
                    z[0] = x[0]
                del out[i]
                changed = True
                break
    s, out = out, []
    for x in s:
        if out and out[-1][2] == x[2]:
            out[-1][1] = x[1]
        else:
            out.append(x)
    return out


def chapters_build(frames: DataFrame, labels: list[str], idle: list[str], fps: float, half_window: int, confirmed: DataFrame | None = None, trim: int = 0) -> DataFrame:
    """Chapters from labelled frames: vote, runs, ``built``; active ones trimmed to ``trim`` frames around confirmed frames.

    A chapter in which under 30 per cent of the frames are confirmed is not trimmed.
    """
    voted = majority_vote(frames, labels, idle, half_window)
    runs = label_runs(voted.select("series_id", "frame_id", F.col("vote").alias("label")))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start_frame", kind="stable")
        a, z, label = zip(*built(rows[["start_frame", "end_frame", "label"]].to_numpy().tolist(), fps, tuple(idle)), strict=True)
        return pd.DataFrame({"series_id": rows["series_id"].iloc[0], "start_frame": a, "end_frame": z, "label": label})

    out = grouped(runs, ("series_id",), run, "series_id long, start_frame long, end_frame long, label string")
    if confirmed is None:
        return out
    ok = confirmed.select("series_id", "frame_id", F.lit(True).alias("_ok")).distinct()
    seen = frames.select("series_id", "frame_id").join(ok, ["series_id", "frame_id"], "left").withColumn("_k", F.lit(1))
    # chapters do not meet, so a frame belongs to the last one that begins before it or to none
    starts = out.select("series_id", F.col("start_frame").alias("frame_id"), F.lit(0).alias("_k"), F.struct("start_frame", "end_frame", "label").alias("_c"))
    order = Window.partitionBy("series_id").orderBy("frame_id", "_k").rowsBetween(Window.unboundedPreceding, 0)
    held = starts.unionByName(seen, allowMissingColumns=True).withColumn("_c", F.last("_c", ignorenulls=True).over(order))
    held = held.where("_k = 0 or frame_id <= _c.end_frame").withColumn("_f", F.when(F.col("_k") == 1, F.col("frame_id")))
    hit = F.when(F.col("_ok"), F.col("_f"))
    by = held.groupBy("series_id", F.col("_c.start_frame").alias("start_frame"), F.col("_c.end_frame").alias("end_frame"), F.col("_c.label").alias("label")).agg(
        F.count("_f").alias("n"), F.count(hit).alias("k"), F.min(hit).alias("first"), F.max(hit).alias("last")
    )
    a, z = F.greatest("start_frame", F.col("first") - trim), F.least("end_frame", F.col("last") + trim)
    cut = ~F.col("label").isin(*idle) & (F.col("k") > 0) & (F.col("k") / F.col("n") >= 0.3) & (a < z)
    return by.select("series_id", F.when(cut, a).otherwise(F.col("start_frame")).alias("start_frame"), F.when(cut, z).otherwise(F.col("end_frame")).alias("end_frame"), "label")


def chapters_relabel(chapters: DataFrame, labels: DataFrame, idle: list[str]) -> DataFrame:
    """Chapters with the labels ``(series_id, start_frame, end_frame, label)``, where these are not null and the chapter is not idle;
    neighbours that now share a label become one, from the first start to the last end."""
    new = labels.select("series_id", "start_frame", "end_frame", F.col("label").alias("_new"))
    named = F.when(~F.col("label").isin(*idle), F.col("_new"))
    rows = chapters.join(new, ["series_id", "start_frame", "end_frame"], "left").withColumn("label", F.coalesce(named, F.col("label")))
    order = Window.partitionBy("series_id").orderBy("start_frame", "end_frame")
    other = F.coalesce((~F.col("label").eqNullSafe(F.lag("label").over(order))).cast("int"), F.lit(1))
    rows = rows.withColumn("_o", F.when(F.row_number().over(order) == 1, 1).otherwise(other))
    rows = rows.withColumn("_run", F.sum("_o").over(order))
    out = rows.groupBy("series_id", "_run").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.first("label").alias("label"))
    return out.select("series_id", "start_frame", "end_frame", "label")


def chapters_consume(chapters: DataFrame, pairs: DataFrame) -> DataFrame:
    """Join each pair ``(series_id, first_id, second_id)`` over the gap between them, under the earlier one's id and label, and drop
    the chapters that lie wholly within the joined range; those that reach out of it stay.

    A series' pairs are few; a pair without both chapters changes nothing.
    """
    c = chapters.select("series_id", "chapter_id", "label", "start_frame", "end_frame")
    side = lambda n, p: c.select("series_id", F.col("chapter_id").alias(n), F.struct("start_frame", "chapter_id", "label", "end_frame").alias(p))
    both = pairs.join(side("first_id", "a"), ["series_id", "first_id"]).join(side("second_id", "b"), ["series_id", "second_id"]).where("first_id <> second_id")
    swap = F.col("a.start_frame") > F.col("b.start_frame")
    early, late = F.when(swap, F.col("b")).otherwise(F.col("a")), F.when(swap, F.col("a")).otherwise(F.col("b"))
    done = both.select("series_id", "first_id", "second_id", early["chapter_id"].alias("chapter_id"), early["label"].alias("label"), early["start_frame"].alias("start_frame"), late["end_frame"].alias("end_frame"))
    span = done.select(F.col("series_id").alias("_s"), "first_id", "second_id", F.col("start_frame").alias("_a"), F.col("end_frame").alias("_z"))
    inside = (F.col("series_id") == F.col("_s")) & (F.col("chapter_id").isin(F.col("first_id"), F.col("second_id")) | ((F.col("start_frame") >= F.col("_a")) & (F.col("end_frame") <= F.col("_z"))))
    return c.join(span, inside, "left_anti").unionByName(done.select(c.columns))


def first_of_times(points: DataFrame) -> DataFrame:
    """Of the points of one time the first."""
    order = Window.partitionBy(*KEY, "at").orderBy("seq", "pos")
    return points.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def chapters_join(chapters: DataFrame, pairs: DataFrame) -> DataFrame:
    """Join the chapters of each pair ``(series_id, first_id, second_id)`` under the earlier one's id and label, unless the
    joined range meets a third chapter; a pair that can't be joined changes nothing."""
    c = chapters.select("series_id", "chapter_id", "label", "start_frame", "end_frame")
    side = lambda n, p: c.select("series_id", F.col("chapter_id").alias(n), F.struct("start_frame", "end_frame", "chapter_id", "label").alias(p))
    both = pairs.join(side("first_id", "a"), ["series_id", "first_id"]).join(side("second_id", "b"), ["series_id", "second_id"]).where("first_id <> second_id")
    early = F.least("a", "b")
    both = both.select("series_id", "first_id", "second_id", early["chapter_id"].alias("chapter_id"), early["label"].alias("label"), early["start_frame"].alias("start_frame"), F.greatest("a.end_frame", "b.end_frame").alias("end_frame"))
    o = c.select(F.col("series_id").alias("_s"), F.col("chapter_id").alias("_id"), F.col("start_frame").alias("_a"), F.col("end_frame").alias("_z"))
    meets = (F.col("series_id") == F.col("_s")) & ~F.col("_id").isin(F.col("first_id"), F.col("second_id")) & (F.greatest("start_frame", "_a") <= F.least("end_frame", "_z"))
    done = both.join(o, meets, "left_anti")
    gone = done.select("series_id", F.explode(F.array("first_id", "second_id")).alias("chapter_id"))
    return c.join(gone, ["series_id", "chapter_id"], "left_anti").unionByName(done.select(c.columns))


def last_window(points: DataFrame, window_ms: int) -> DataFrame:
    """Points of the last ``window_ms`` of each series."""
    return points.withColumn("_z", F.max("at").over(Window.partitionBy(*KEY)) - window_ms).where(F.col("at") >= F.col("_z")).drop("_z")
