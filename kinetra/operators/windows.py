"""Operators over the ordered points of a series, all with the one window of ``schema.series``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetra.operators.groups import Change, change_series
from kinetra.operators.kernels import sliding_percentile
from kinetra.schema import KEY, clip, rint, series, to_pos, whole


def around(c: str = "pos") -> tuple[Column, Column]:
    """A column's values at the point before and the point after."""
    return F.lag(c).over(series()), F.lead(c).over(series())


def speed(dpos: Column, dt: Column) -> Column:
    """Positions a second; times that don't move on count as 1 ms."""
    return F.abs(dpos) / F.greatest(dt, F.lit(1)) * 1000


def segment_speeds(df: DataFrame) -> DataFrame:
    """One row for each pair of consecutive points: start, end and speed."""
    at, pos = F.lead("at").over(series()), F.lead("pos").over(series())
    rows = df.select(*KEY, F.col("at").alias("start"), at.alias("end"), F.col("pos").alias("from_pos"), pos.alias("to_pos"))
    return rows.where("end is not null").withColumn("speed", speed(F.col("to_pos") - F.col("from_pos"), F.col("end") - F.col("start")))


def speed_violations(df: DataFrame, limit: float) -> DataFrame:
    return segment_speeds(df).where(F.col("speed") > limit)


def strict_extrema(df: DataFrame) -> DataFrame:
    """``top``: above both neighbours; ``bottom``: under both. Ends are neither."""
    before, after = around()
    p = F.col("pos")
    marked = df.withColumns({"_b": before, "_n": after})
    top, bottom = (p > F.col("_b")) & (p > F.col("_n")), (p < F.col("_b")) & (p < F.col("_n"))
    return marked.withColumns({"top": F.coalesce(top, F.lit(False)), "bottom": F.coalesce(bottom, F.lit(False))}).drop("_b", "_n")


def select_extrema(df: DataFrame, kind: str = "both") -> DataFrame:
    """Tops (over the point before, not under the next) and bottoms; an end is held against its one neighbour, strictly."""
    marked = df.withColumns(dict(zip(("_b", "_n"), around(), strict=True)))
    p, b, n = F.col("pos"), F.col("_b"), F.col("_n")

    def of(over, not_under) -> Column:
        inner = over(p, b) & not_under(p, n)
        return F.when(b.isNull() & n.isNull(), False).when(b.isNull(), over(p, n)).when(n.isNull(), over(p, b)).otherwise(inner)

    top, bottom = of(Column.__gt__, Column.__ge__), of(Column.__lt__, Column.__le__)
    return marked.where({"top": top, "bottom": bottom, "both": top | bottom}[kind]).drop("_b", "_n")


def selection_extrema(df: DataFrame, kind: str, selected: Column) -> DataFrame:
    """Tops, bottoms or the rest among selected points; a missing neighbour counts as -1."""
    rows = df.where(selected).withColumns({"_b": F.lag("pos", 1, -1).over(series()), "_n": F.lead("pos", 1, -1).over(series())})
    p, b, n = F.col("pos"), F.col("_b"), F.col("_n")
    top, bottom = (p > b) & (p >= n), (p < b) & (p <= n)
    return rows.where({"top": top, "bottom": bottom, "mid": ~top & ~bottom}[kind]).drop("_b", "_n")


def reversal_peaks(df: DataFrame, tolerance: float = 2) -> DataFrame:
    """First, last and points where the movement turns by more than ``tolerance`` on both sides; all of a series under three."""
    rows = df.withColumns(dict(zip(("_b", "_n"), around(), strict=True)) | {"_c": F.count("*").over(whole())})
    come, go = F.col("pos") - F.col("_b"), F.col("_n") - F.col("pos")
    turns = ((come > tolerance) & (go < -tolerance)) | ((come < -tolerance) & (go > tolerance))
    return rows.where((F.col("_c") < 3) | F.col("_b").isNull() | F.col("_n").isNull() | turns).drop("_b", "_n", "_c")


def plateau_anchors(df: DataFrame) -> DataFrame:
    """Ends, strict extrema, and the middle point (the left one of two) of a flat run that is an extremum."""
    rows = df.withColumn("_new", F.coalesce((F.col("pos") != F.lag("pos").over(series())).cast("int"), F.lit(1)))
    before, after = around()
    rows = rows.withColumns({"_run": F.sum("_new").over(series()), "_i": F.row_number().over(series()), "_before": before, "_after": after})
    # the points beside a run are those beside its first and last point, told to all of it without another exchange
    run = Window.partitionBy(*KEY, "_run")
    rows = rows.withColumns({"_f": F.min("_i").over(run), "_l": F.max("_i").over(run), "_m": F.max("_i").over(whole())})
    rows = rows.withColumns({"_b": F.max(F.when(F.col("_i") == F.col("_f"), F.col("_before"))).over(run), "_n": F.max(F.when(F.col("_i") == F.col("_l"), F.col("_after"))).over(run)})
    p, b, n = F.col("pos"), F.col("_b"), F.col("_n")
    turn = F.coalesce(((p > b) & (p > n)) | ((p < b) & (p < n)), F.lit(False))
    end = (F.col("_i") == 1) | (F.col("_i") == F.col("_m"))
    middle = F.col("_i") == F.floor((F.col("_f") + F.col("_l")) / 2)
    return rows.where(end | (turn & middle)).select(df.columns)


def drop_speed_artifacts(df: DataFrame, limit: float = 800) -> DataFrame:
    """Drop inner points that are both reached and left faster than ``limit``; neighbours are the original ones."""

    def fast(dpos: Column, dt: Column) -> Column:
        return F.when(dt <= 0, F.lit(True)).otherwise(F.abs(dpos) / dt * 1000 > limit)

    rows = df.withColumns({f"_{c}{k}": f(c).over(series()) for k, f in (("b", F.lag), ("n", F.lead)) for c in ("at", "pos")})
    reached = fast(F.col("pos") - F.col("_posb"), F.col("at") - F.col("_atb"))
    left = fast(F.col("_posn") - F.col("pos"), F.col("_atn") - F.col("at"))
    inner = F.col("_atb").isNotNull() & F.col("_atn").isNotNull()
    return rows.where(~(inner & reached & left)).select(df.columns)


def dynamic_amplify(df: DataFrame, window_ms: int = 4000, min_range: int = 5) -> DataFrame:
    """Stretch to the full range of the time window around each point, where that range is wide enough."""
    near = Window.partitionBy(*KEY).orderBy("at").rangeBetween(-(window_ms // 2), window_ms // 2)
    rows = df.withColumns({"_lo": F.min("pos").over(near), "_hi": F.max("pos").over(near)})
    span = F.col("_hi") - F.col("_lo")
    value = F.when(span >= min_range, to_pos((F.col("pos") - F.col("_lo")) / span * 100)).otherwise(F.col("pos"))
    return rows.withColumn("pos", value.cast("int")).drop("_lo", "_hi")


def savgol_weights(window: int, degree: int) -> np.ndarray:
    """Rows: weights of the window's values for the fitted polynomial at each of its places."""
    x = np.vander(np.arange(window) - window // 2, degree + 1)
    return x @ np.linalg.pinv(x)


def savgol(df: DataFrame, window: int = 7, degree: int = 3) -> DataFrame:
    """Savitzky-Golay smoothing; the first and last half window take the polynomial of the first and last window.

    An even window grows by one; a series of fewer points stays as it is.
    """
    window += 1 - window % 2
    if degree >= window:
        raise ValueError("degree must be less than window")
    w, half = savgol_weights(window, degree), window // 2
    rows = df.withColumns({"_i": F.row_number().over(series()), "_c": F.count("*").over(whole())})
    # place of the window's first point relative to this one, and the point's place in that window
    first = F.greatest(F.lit(1), F.least(F.col("_i") - half, F.col("_c") - window + 1))
    rows = rows.withColumn("_v", F.collect_list("pos").over(series().rowsBetween(-(window - 1), window - 1)))
    offset = first - F.greatest(F.col("_i") - (window - 1), F.lit(1))
    rows = rows.withColumns({"_o": offset.cast("int"), "_k": (F.col("_i") - first).cast("int")})
    part = F.zip_with(F.slice("_v", F.col("_o") + 1, window), _row(w, F.col("_k")), lambda a, b: a * b)
    value = to_pos(F.round(F.aggregate(part, F.lit(0.0), lambda a, b: a + b), 9))
    return rows.withColumn("pos", F.when(F.col("_c") >= window, value).otherwise(F.col("pos"))).select(df.columns)


def _row(w: np.ndarray, k: Column) -> Column:
    return F.element_at(F.array(*[F.array(*map(F.lit, r.tolist())) for r in w]), k + 1)


def moving_normalize(df: DataFrame, window: int = 7, span: float = 50) -> DataFrame:
    """Deviation from a trapezoid moving average over the mean deviation near by, around 50; three points at least.

    The average runs over rows -h to h, its outer two counting half, over ``window`` - 1 at the ends too; the
    mean deviation over rows -h to h-1, over the number of neighbours.
    """
    h = window // 2
    wide, short = series().rowsBetween(-h, h), series().rowsBetween(-h, h - 1)
    rows = df.withColumns(
        {"_s": F.sum("pos").over(wide), "_a": F.first("pos").over(wide), "_z": F.last("pos").over(wide), "_n": F.count("*").over(wide), "_c": F.count("*").over(whole())}
    )
    rows = rows.withColumn("_m", (F.col("_s") - (F.col("_a") + F.col("_z")) / 2) / max(window - 1, 1))
    rows = rows.withColumn("_e", F.try_divide(F.sum(F.abs(F.col("pos") - F.col("_m"))).over(short), F.col("_n") - 1))
    value = to_pos(F.round(50 + 0.005 * span * (F.col("pos") - F.col("_m")) / F.col("_e") * 100, 6))
    return rows.withColumn("pos", F.when((F.col("_c") >= 3) & (F.col("_e") > 0), value).otherwise(F.col("pos"))).select(df.columns)


def detrend(df: DataFrame, sample: int = 4, adjust_range: bool = True) -> DataFrame:
    """Remove a drift of centre (and range) between the first and the last n + 1 points, linear in time.

    n is ``sample``, at most half the points; series under four points or without duration stay.
    """
    rows = df.withColumns({"_i": F.row_number().over(series()), "_c": F.count("*").over(whole())})
    n = F.least(F.lit(sample), F.floor(F.col("_c") / 2))
    cols = {"_t0": F.min("at").over(whole()), "_t1": F.max("at").over(whole())}
    for k, inside in (("a", F.col("_i") <= n + 1), ("z", F.col("_i") >= F.col("_c") - n)):
        value = F.when(inside, F.col("pos"))
        cols |= {f"_lo{k}": F.min(value).over(whole()), f"_hi{k}": F.max(value).over(whole())}
    rows = rows.withColumns(cols)
    part = (F.col("at") - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))
    mix = lambda a, z: a + (z - a) * part
    centre = mix((F.col("_loa") + F.col("_hia")) / 2, (F.col("_loz") + F.col("_hiz")) / 2)
    span = F.greatest(mix(F.col("_hia") - F.col("_loa"), F.col("_hiz") - F.col("_loz")), F.lit(1)) if adjust_range else F.lit(50)
    value = to_pos(F.round(50 * (F.col("pos") - centre) / span + 50, 6))
    return rows.withColumn("pos", F.when((F.col("_c") >= 4) & (F.col("_t1") > F.col("_t0")), value).otherwise(F.col("pos"))).select(df.columns)


def align_peaks(df: DataFrame) -> DataFrame:
    """Strict tops to the highest position of the series, strict bottoms to the lowest."""
    rows = strict_extrema(df).withColumns({"_lo": F.min("pos").over(whole()), "_hi": F.max("pos").over(whole())})
    value = F.when(F.col("top"), F.col("_hi")).when(F.col("bottom"), F.col("_lo")).otherwise(F.col("pos"))
    return rows.withColumn("pos", value).select(df.columns)


def align_sections(df: DataFrame, mark: Column) -> DataFrame:
    """Shift the points from each marked one up to the next, so that the middle of the two comes to the marks' mean.

    A section never moves its own end, so all ends are read as they were; what follows the last mark stays.
    """
    rows = df.withColumn("_p", F.when(mark, F.col("pos")))
    # the next mark is the last one of the reversed order, which takes one pass
    later = Window.partitionBy(*KEY).orderBy(F.desc("at"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {"_mean": F.avg("_p").over(whole()), "_a": F.last("_p", ignorenulls=True).over(series()), "_z": F.last("_p", ignorenulls=True).over(later)}
    )
    value = to_pos(F.round(F.col("pos") + F.col("_mean") - (F.col("_a") + F.col("_z")) / 2, 6))
    return rows.withColumn("pos", F.coalesce(value, F.col("pos"))).select(df.columns)


def align_top_bottom(df: DataFrame, mode: str = "top") -> DataFrame:
    """``align_sections`` between strict tops (or bottoms)."""
    return align_sections(strict_extrema(df), F.col(mode)).select(df.columns)


def fit_range(df: DataFrame, low: int = 0, high: int = 100) -> DataFrame:
    """Linear rescale of the series' range; a flat series stays."""
    rows = df.withColumns({"_lo": F.min("pos").over(whole()), "_hi": F.max("pos").over(whole())})
    value = to_pos(low + (F.col("pos") - F.col("_lo")) * (high - low) / (F.col("_hi") - F.col("_lo")))
    return rows.withColumn("pos", F.when(F.col("_hi") > F.col("_lo"), value).otherwise(F.col("pos"))).drop("_lo", "_hi")


def range_extend(df: DataFrame, amount: float = 10) -> DataFrame:
    """Scale distances from the middle of the range by (d + amount) / d, d being half the range; under 0.5 nothing changes."""
    rows = df.withColumns({"_lo": F.min("pos").over(whole()), "_hi": F.max("pos").over(whole())})
    middle, d = (F.col("_lo") + F.col("_hi")) / 2, (F.col("_hi") - F.col("_lo")) / 2
    value = to_pos(F.round(middle + (F.col("pos") - middle) * ((d + amount) / d), 9))
    return rows.withColumn("pos", F.when(d >= 0.5, value).otherwise(F.col("pos"))).drop("_lo", "_hi")


def scale_percentile_range(df: DataFrame, low: int = 0, high: int = 100, tail: float = 0.1) -> DataFrame:
    """The range between the series' outer percentiles becomes ``low`` to ``high``, clipped; a flat one its middle."""
    bounds = df.groupBy(*KEY).agg(F.percentile("pos", tail).alias("_lo"), F.percentile("pos", 1 - tail).alias("_hi"))
    rows = df.join(bounds, list(KEY))
    span = F.col("_hi") - F.col("_lo")
    value = F.round(low + (F.col("pos") - F.col("_lo")) / span * (high - low), 9)
    flat = F.lit(int(round((low + high) / 2)))
    return rows.withColumn("pos", F.when(span > 0, clip(rint(value), low, high)).otherwise(flat).cast("int")).select(df.columns)


def equalize_times(df: DataFrame) -> DataFrame:
    """Spread the points of a series of three or more evenly between its first and last time."""
    rows = df.withColumns({"_i": F.row_number().over(series()) - 1, "_c": F.count("*").over(whole()), "_a": F.min("at").over(whole()), "_z": F.max("at").over(whole())})
    value = F.rint(F.col("_a") + F.col("_i") * (F.col("_z") - F.col("_a")) / (F.col("_c") - 1)).cast("long")
    return rows.withColumn("at", F.when(F.col("_c") >= 3, value).otherwise(F.col("at"))).select(df.columns)


def centre_in_time(df: DataFrame) -> DataFrame:
    """Every inner point half way between the original times of its neighbours."""
    before, after = around("at")
    rows = df.withColumns({"_b": before, "_n": after})
    return rows.withColumn("at", F.coalesce(rint((F.col("_b") + F.col("_n")) / 2), F.col("at"))).select(df.columns)


def adjust_timing(df: DataFrame, cursor: int) -> DataFrame:
    """The point nearest to ``cursor`` moves there, the others in proportion between it and the unmoved ends."""
    near = F.min_by("at", F.struct(F.abs(F.col("at") - cursor), F.col("at"))).over(whole())
    rows = df.withColumns({"_a": F.min("at").over(whole()), "_z": F.max("at").over(whole()), "_t": near, "_c": F.count("*").over(whole())})
    at, a, z, t = (F.col(c) for c in ("at", "_a", "_z", "_t"))
    left = F.when(t != a, F.rint(F.round(a + (cursor - a) / (t - a) * (at - a), 6))).otherwise(at)
    right = F.when(t != z, F.rint(F.round(z + (cursor - z) / (t - z) * (at - z), 6))).otherwise(at)
    value = F.when(at == t, F.lit(cursor)).when(at < cursor, left).otherwise(right).cast("long")
    return rows.withColumn("at", F.when(F.col("_c") >= 2, value).otherwise(at)).select(df.columns)


def snap_nearest(df: DataFrame, t: int, selected: Column | None = None) -> DataFrame:
    """The (selected) point nearest to ``t`` moves there, at most to 1 ms from its neighbours, selected or not."""
    before, after = around("at")
    order = F.struct(F.abs(F.col("at") - t), F.col("at"), F.col("seq"))
    near = F.min_by(F.struct("at", "seq"), order if selected is None else F.when(selected, order)).over(whole())
    rows = df.withColumns({"_b": before, "_n": after, "_t": near})
    value = F.greatest(F.coalesce(F.col("_b") + 1, F.lit(0)), F.coalesce(F.least(F.col("_n") - 1, F.lit(t)), F.lit(t)))
    hit = F.struct("at", "seq") == F.col("_t")
    return rows.withColumn("at", F.when(hit, value).otherwise(F.col("at")).cast("long")).select(df.columns)


def oscillation_runs(df: DataFrame, min_move: int = 5, min_ms: int = 5000) -> DataFrame:
    """Runs of consecutive moves smaller than ``min_move`` that last ``min_ms`` or longer: start, end, moves."""
    at, pos = F.lead("at").over(series()), F.lead("pos").over(series())
    moves = df.withColumns({"_at": at, "_small": F.abs(pos - F.col("pos")) < min_move}).where("_at is not null")
    new = F.coalesce((F.col("_small") != F.lag("_small").over(series())).cast("int"), F.lit(1))
    moves = moves.withColumn("_new", new).withColumn("_run", F.sum("_new").over(series()))
    runs = moves.where("_small").groupBy(*KEY, "_run").agg(F.min("at").alias("start"), F.max("_at").alias("end"), F.count("*").alias("moves"))
    return runs.where(F.col("end") - F.col("start") >= min_ms).drop("_run")


def rolling_percentile(df: DataFrame, window_ms: int = 30_000, p: float = 0.95, value: str = "pos", otherwise: Column | None = None, size: float | None = None) -> DataFrame:
    """``ref``: percentile of the values of the last ``window_ms`` up to each point, equal times included.

    Where these hold no value it is ``otherwise`` (of the point's segment), if that is over zero, else three tenths of ``size``. The
    window's values are kept in order while it slides, so a point costs a look-up, however many the window holds.
    """
    back = F.lit(None if size is None else 0.3 * size).cast("double")
    back = back if otherwise is None else F.when(otherwise > 0, otherwise.cast("double")).otherwise(back)
    rows = df.withColumns({"ref": F.lit(None).cast("double"), "_v": F.col(value).cast("double"), "_back": back})

    def run(x: dict[str, np.ndarray]) -> Change:
        return None, {"ref": sliding_percentile(x["at"], x["_v"].astype(float), x["_back"].astype(float), window_ms, p)}

    return change_series(rows, run, ("at", "_v", "_back")).drop("_v", "_back")


def rolling_height(df: DataFrame, rows: int = 5, value: str = "pos") -> DataFrame:
    """``height``: mean of the values over zero among the last ``rows`` points, else 0."""
    w = series().rowsBetween(-(rows - 1), 0)
    return df.withColumn("height", F.coalesce(F.avg(F.when(F.col(value) > 0, F.col(value))).over(w), F.lit(0.0)))


def zscore(df: DataFrame, rows: int = 60, value: str = "pos") -> DataFrame:
    """``z``: distance from the mean of the last ``rows`` points in their standard deviations; 0 where these are flat."""
    w = series().rowsBetween(-(rows - 1), 0)
    out = df.withColumns({"_m": F.avg(value).over(w), "_s": F.stddev_pop(value).over(w)})
    z = F.when(F.col("_s") > 1e-9, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(F.lit(0.0))
    return out.withColumn("z", z).drop("_m", "_s")
