"""Sequential filters as jobs: the helpers of ``kernels`` applied to every series.

A series is one group, in time order: these filters have no form that splits it. Everything else (reading,
spreading over the cluster, what is built of windows) is Spark's.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetra.operators import kernels as K
from kinetra.operators.groups import Change, change_series, frames_of
from kinetra.operators.windows import plateau_anchors
from kinetra.schema import KEY, clip, rint, series, to_pos

Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def per_series(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """``fn`` on every series in time order, with the columns of ``df``."""
    return frames_of(df, fn)


def _keeping(df: DataFrame, mask: Kernel) -> DataFrame:
    return change_series(df, lambda x: (mask(x["at"], x["pos"]), {}))


def _moving(df: DataFrame, pos: Kernel) -> DataFrame:
    return change_series(df, lambda x: (None, {"pos": pos(x["at"], x["pos"])}))


def min_interval_filter(df: DataFrame, gap: int = 10) -> DataFrame:
    return _keeping(df, lambda at, pos: K.min_interval(at, gap))


def online_simplify(df: DataFrame, tolerance: float = 2) -> DataFrame:
    return _keeping(df, lambda at, pos: K.online_simplify(at, pos, tolerance))


def rdp_simplify(df: DataFrame, tolerance: float = 8, auto_scale: bool = True) -> DataFrame:
    return _keeping(df, lambda at, pos: K.rdp(at, pos, tolerance, auto_scale))


def recording_simplify(df: DataFrame, tolerance: float = 2) -> DataFrame:
    return _keeping(df, lambda at, pos: K.recording_simplify(at, pos, tolerance))


def visvalingam_simplify(df: DataFrame, area: float = 2) -> DataFrame:
    """Both ends and the extrema of prominence 1 first, then the smallest triangles; under three points all stay."""

    def mask(at: np.ndarray, pos: np.ndarray) -> np.ndarray:
        keep = np.ones(len(pos), dtype=bool)
        if len(pos) > 2:
            keep[1:-1] = False
            keep[np.concatenate([K.find_peaks(pos, prominence=1), K.find_peaks(-pos.astype(float), prominence=1)]).astype(int)] = True
        place = np.flatnonzero(keep)
        keep[place[~K.visvalingam(at[place], pos[place], area)]] = False
        return keep

    return _keeping(df, mask)


def keyframes(df: DataFrame, tolerance: float = 10) -> DataFrame:
    return _keeping(df, lambda at, pos: K.keyframes(at, pos, tolerance))


def anti_jerk(df: DataFrame, jerk: float = 20, main: float = 50, deviation: float = 15) -> DataFrame:
    return _keeping(df, lambda at, pos: K.anti_jerk(at, pos, jerk, main, deviation))


def find_peaks_valleys(df: DataFrame, **limits: float) -> DataFrame:
    """Ends, peaks, and peaks of 100 less the position; limits of ``kernels.find_peaks``."""

    def mask(at: np.ndarray, pos: np.ndarray) -> np.ndarray:
        keep = np.ones(len(pos), dtype=bool)
        if len(pos) > 2:
            keep[1:-1] = False
            keep[K.find_peaks(pos, **limits)] = True
            keep[K.find_peaks(100 - pos, **limits)] = True
        return keep

    return _keeping(df, mask)


def speed_limit(df: DataFrame, gap: int = 60, vibe: int = 0, speed: float = 500) -> DataFrame:
    """Drop short intervals, optionally turn small moves into vibration, then limit the speed of what comes out."""

    def change(x: dict[str, np.ndarray]) -> Change:
        at, pos = x["at"], x["pos"]
        if len(at) < 2:
            return None, {"pos": pos}
        keep = K.backward_interval(at, gap)
        return keep, {"pos": K.limit_speed(at[keep], K.vibrate(at[keep], pos[keep], vibe), speed)}

    return change_series(df, change)


def _selected(df: DataFrame, selected: Column, column: str, fn: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """A column anew by times, positions and what is selected."""
    marked = df.withColumn("_selected", F.coalesce(selected, F.lit(False)))
    step = lambda x: (None, {column: fn(x["at"], x["pos"], x["_selected"].astype(bool))})
    return change_series(marked, step, ("at", "pos", "_selected")).select(df.columns)


def speed_limit_selected(df: DataFrame, selected: Column, speed: float = 500) -> DataFrame:
    return _selected(df, selected, "pos", lambda at, pos, chosen: K.limit_speed_selected(at, pos, chosen, speed) if chosen.sum() > 1 else pos)


def directional_speed_limit(df: DataFrame, speed: float = 600, bias: str = "symmetric", prepare: bool = False, selected: Column | None = None) -> DataFrame:
    if selected is not None:
        return _selected(df, selected, "pos", lambda at, pos, chosen: K.directional_limit(at, pos, speed, bias, prepare, chosen))
    return _moving(df, lambda at, pos: K.directional_limit(at, pos, speed, bias, prepare))


def continue_minmax(df: DataFrame, selected: Column, lookback: int = 4) -> DataFrame:
    return _selected(df, selected, "pos", lambda at, pos, chosen: K.continue_minmax(pos, chosen, lookback))


def nudge_time_selected(df: DataFrame, selected: Column, delta: int) -> DataFrame:
    return _selected(df, selected, "at", lambda at, pos, chosen: K.nudge_times(at, chosen, delta))


def recover_strokes(kept: DataFrame, original: DataFrame, factor: float = 1.8) -> DataFrame:
    """For each gap of ``kept`` over ``factor`` times the median one, the original point farthest from the line in it."""
    seg = kept.select(*KEY, "at", "pos", F.lead("at").over(series()).alias("_e"), F.lead("pos").over(series()).alias("_q"))
    seg = seg.where(F.col("_e") > F.col("at")).withColumn("_d", F.col("_e") - F.col("at"))
    usual = seg.groupBy(*KEY).agg(F.percentile("_d", 0.5).alias("_m"), F.count("*").alias("_n")).where("_n >= 2")
    wide = seg.join(usual, list(KEY)).where(F.col("_d") > F.col("_m") * factor).select(*KEY, F.col("at").alias("_a"), "_e", F.col("pos").alias("_p"), "_q")
    # gaps do not meet, so a point lies in the last one that begins before it or in none
    gaps = wide.select(*KEY, F.col("_a").alias("at"), F.lit(1).alias("_k"), F.struct("_a", "_e", "_p", "_q").alias("_g"))
    rows = original.select(*KEY, "at", "pos", "seq", F.lit(0).alias("_k")).unionByName(gaps, allowMissingColumns=True)
    order = Window.partitionBy(*KEY).orderBy("at", "_k").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("_g", F.last("_g", ignorenulls=True).over(order)).where("_k = 0 and at < _g._e").select(*KEY, "at", "pos", "seq", "_g.*")
    line = F.col("_p") + (F.col("at") - F.col("_a")) / (F.col("_e") - F.col("_a")) * (F.col("_q") - F.col("_p"))
    far = F.struct(F.round(F.abs(F.col("pos") - line), 9), -F.col("at"), -F.col("seq"))
    best = inside.groupBy(*KEY, "_a").agg(F.max_by(F.struct("at", "pos", "seq"), far).alias("b"))
    return best.select(*KEY, "b.at", "b.pos", "b.seq")


def resample_peaks(df: DataFrame, step: int = 50) -> DataFrame:
    """Cosine ease between plateau anchors every ``step`` ms; rows ``(series_id, axis, at, pos)``."""
    a = plateau_anchors(df)
    seg = a.select(*KEY, "at", "pos", F.lead("at").over(series()).alias("_e"), F.lead("pos").over(series()).alias("_q"))
    times = F.when(F.col("_e") - F.col("at") > step, F.sequence(F.col("at") + step, F.col("_e") - 1, F.lit(step).cast("long")))
    inner = seg.withColumn("t", F.explode(times))
    part = (F.col("t") - F.col("at")) / (F.col("_e") - F.col("at"))
    value = F.col("pos") + (1 - F.cos(part * F.lit(np.pi))) / 2 * (F.col("_q") - F.col("pos"))
    new = inner.select(*KEY, F.col("t").alias("at"), to_pos(F.round(value, 6)).alias("pos"))
    return a.select(*KEY, "at", "pos").unionByName(new)


def inject_points(df: DataFrame, interval: float = 100, adaptive: bool = True, method: str = "linear") -> DataFrame:
    """Further points in each segment longer than ``interval``, closer where it is fast; rows ``(series_id, axis, at, pos)``."""
    seg = df.select(*KEY, "at", "pos", F.lead("at").over(series()).alias("_e"), F.lead("pos").over(series()).alias("_q"))
    dt = F.col("_e") - F.col("at")
    factor = clip(F.abs(F.col("_q") - F.col("pos")) / dt * 1000 / 200, 0.5, 2.0) if adaptive else F.lit(1.0)
    seg = seg.where(dt > interval).withColumn("_n", F.greatest(F.lit(1), F.floor(dt / (F.lit(float(interval)) / factor))).cast("int"))
    inner = seg.where("_n > 1").withColumn("j", F.explode(F.sequence(F.lit(1), F.col("_n") - 1)))
    f = F.col("j") / F.col("_n")
    eased = {"linear": f, "cosine": (1 - F.cos(f * F.lit(np.pi))) / 2, "cubic": f * f * (3 - 2 * f)}[method]
    value = F.round(F.col("pos") + eased * (F.col("_q") - F.col("pos")), 6)
    new = inner.select(*KEY, rint(F.round(F.col("at") + (F.col("_e") - F.col("at")) * f, 6)).alias("at"), to_pos(value).alias("pos"))
    return df.select(*KEY, "at", "pos").unionByName(new)


def repeat_last_stroke(df: DataFrame, t: int, fps: float = 30.0) -> DataFrame:
    """Repeat the two points before ``t`` after them, unless a point lies near; the new points only."""
    before = df.where(F.col("at") < t).withColumn("_r", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("at"), F.desc("seq"))))
    of = lambda r, c: F.max(F.when(F.col("_r") == r, F.col(c)))
    pair = before.where("_r <= 2").groupBy(*KEY).agg(of(2, "at").alias("a1"), of(2, "pos").alias("p1"), of(1, "at").alias("a2"), of(1, "pos").alias("p2"))
    pair = pair.where("a2 > a1").withColumn("dt", F.col("a2") - F.col("a1"))
    new = pair.select(*KEY, F.col("a2").alias("_a2"), F.col("dt").alias("_dt"), F.inline(F.array(*[F.struct((F.col("a2") + F.col("dt") * k).alias("at"), F.col(p).alias("pos")) for k, p in ((1, "p1"), (2, "p2"))])))
    tol = max(1, int(500 / max(1.0, fps)))
    points = df.select(*KEY, F.col("at").alias("_t"))
    close = new.join(points, list(KEY)).where(F.abs(F.col("_t") - F.col("at")) <= tol).select(*KEY).distinct()
    return new.join(close, list(KEY), "left_anti").select(*KEY, "at", "pos")


def clip_peaks(df: DataFrame, t: int) -> DataFrame:
    """Drop points above the level at ``t`` and add the crossings; a series that doesn't span ``t`` stays."""
    at = F.col("at")
    side = df.groupBy(*KEY).agg(
        F.max_by(F.struct("at", "pos"), F.when(at <= t, F.struct("at", "seq"))).alias("a"), F.min_by(F.struct("at", "pos"), F.when(at > t, F.struct("at", "seq"))).alias("z"),
        F.count(F.when(at <= t, 1)).alias("_l"), F.count(F.when(at > t, 1)).alias("_r"),
    )
    level = F.col("a.pos") + (F.col("z.pos") - F.col("a.pos")) / (F.col("z.at") - F.col("a.at")) * (t - F.col("a.at"))
    level = F.when((F.col("_l") > 0) & (F.col("_r") > 0), level)
    rows = df.withColumns({f"_{c}{k}": f(c).over(series()) for k, f in (("b", F.lag), ("n", F.lead)) for c in ("at", "pos")})
    rows = rows.join(side.select(*KEY, level.alias("_level")), list(KEY))
    over = F.col("pos") > F.col("_level")
    p, lv = F.col("pos"), F.col("_level")
    cross = lambda a, pa, z, pz: rint(F.round(a + (lv - pa) / (pz - pa) * (z - a), 6))
    up = rows.where(over & (F.col("_posb") < lv)).select(*KEY, cross(F.col("_atb"), F.col("_posb"), at, p).alias("at"), F.rint("_level").cast("int").alias("pos"))
    down = rows.where(over & (F.col("_posn") < lv)).select(*KEY, cross(at, p, F.col("_atn"), F.col("_posn")).alias("at"), F.rint("_level").cast("int").alias("pos"))
    return rows.where(~F.coalesce(over, F.lit(False))).select(*KEY, "at", "pos").unionByName(up).unionByName(down)


def fill_gap(df: DataFrame, t: int) -> DataFrame:
    """Cycles for the gap around ``t`` from three points on either side; the new points only."""
    sides = []
    for name, cond, order in (("b", F.col("at") < t, (F.desc("at"), F.desc("seq"))), ("a", F.col("at") > t, (F.col("at"), F.col("seq")))):
        r = df.where(cond).withColumn("_r", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))).where("_r <= 3")
        of = lambda k, c: F.max(F.when(F.col("_r") == k, F.col(c)))
        sides.append(r.groupBy(*KEY).agg(*[of(k, c).alias(f"{name}{c}{k}") for k in (1, 2, 3) for c in ("at", "pos")], F.count("*").alias(f"{name}n")).where(f"{name}n = 3"))
    both = sides[0].join(sides[1], list(KEY))
    c = F.col
    gap, period = c("aat1") - c("bat1"), (c("bat1") - c("bat3")) + (c("aat3") - c("aat1"))
    n = F.rint(2 * gap / period + 0.5).cast("int")
    both = both.where(period > 0).withColumn("_n", n).where("_n >= 1").withColumn("_d", gap / c("_n"))
    peak = F.rint((c("bpos3") + c("bpos1") + c("apos1") + c("apos3")) / 4).cast("int")
    valley = F.rint((c("bpos2") + c("apos2")) / 2).cast("int")
    new = lambda start, upto, pos: both.where(upto >= 1).withColumn("i", F.explode(F.sequence(F.lit(1), upto))).select(
        *KEY, rint(F.round(c(start) + c("i") * c("_d"), 6)).alias("at"), pos.alias("pos")
    )
    return new("bat1", c("_n") - 1, peak).unionByName(new("bat2", c("_n"), valley))
