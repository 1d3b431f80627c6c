"""Statistics, quality and comparison of series. Every aggregate is over one series or its windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetra.operators.groups import grouped
from kinetra.operators.joins import interpolated_pairs, intervals_of
from kinetra.operators.kernels import find_peaks
from kinetra.operators.windows import oscillation_runs
from kinetra.schema import KEY, series


def moves(points: DataFrame) -> DataFrame:
    """One row for each pair of consecutive points: ``at``, ``dt``, ``dp`` (signed)."""
    rows = points.select(*KEY, "at", "pos", "seq", (F.lead("at").over(series()) - F.col("at")).alias("dt"), (F.lead("pos").over(series()) - F.col("pos")).alias("dp"))
    return rows.where("dt is not null")


def series_statistics(points: DataFrame) -> DataFrame:
    """Counts, range, duration, travel, strokes, speed and intervals of every series.

    Strokes are changes of direction between moves that change the position, at least one if any does. Speed
    is travel over the time of such moves. Where there is no interval the mean is 0 and the others -1.
    """
    dt, dp = F.lead("at").over(series()) - F.col("at"), F.lead("pos").over(series()) - F.col("pos")
    rows = points.select(*KEY, "at", "pos", "seq", dt.alias("dt"), dp.alias("dp"))
    way = F.when(F.col("dp") != 0, F.signum("dp"))
    rows = rows.withColumn("way", way)
    rows = rows.withColumn("was", F.last("way", ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, -1)))
    gap = F.when(F.col("dt") > 0, F.col("dt"))
    travel = F.coalesce(F.sum(F.abs("dp")), F.lit(0))
    moving = F.coalesce(F.sum(F.when((F.col("dp") != 0) & (F.col("dt") > 0), F.col("dt"))), F.lit(0))
    turns = F.sum((F.col("way") != F.col("was")).cast("int"))
    n = F.count("*")
    return rows.groupBy(*KEY).agg(
        n.alias("num_points"),
        ((F.max("at") - F.min("at")) / 1000).alias("duration_s"),
        F.min("pos").alias("min_pos"),
        F.max("pos").alias("max_pos"),
        travel.alias("total_travel"),
        F.when(turns > 0, turns).when(travel > 0, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("num_strokes"),
        F.when(moving > 0, travel / (moving / 1000)).otherwise(F.lit(0.0)).alias("avg_speed"),
        F.when(n > 1, travel / (n - 1)).otherwise(F.lit(0.0)).alias("avg_intensity"),
        F.coalesce(F.avg(gap), F.lit(0.0)).alias("avg_interval_ms"),
        F.coalesce(F.min(gap), F.lit(-1)).alias("min_interval_ms"),
        F.coalesce(F.max(gap), F.lit(-1)).alias("max_interval_ms"),
    )


SPEED_LIMIT, SMALL_MOVE, DEAD_MS, CLOSE_MS, FAR_MS, FAR_SHOWN = 500.0, 5, 5000, 20, 5000, 5


def quality_stats(points: DataFrame) -> DataFrame:
    """Numbers of the checks, one row for each series (speeds over 1 ms at least)."""
    rows = points.select(*KEY, "at", "pos", (F.lead("at").over(series()) - F.col("at")).alias("dt"), F.abs(F.lead("pos").over(series()) - F.col("pos")).alias("dp"))
    rows = rows.withColumn("speed", F.col("dp") / F.when(F.col("dt") > 0, F.col("dt")).otherwise(F.lit(1)) * 1000)
    rows = rows.withColumn("speed", F.when(F.col("dt").isNotNull(), F.col("speed")))
    fast = F.col("speed") > SPEED_LIMIT
    count = lambda c: F.count(F.when(c, 1))
    start, end = F.min("at"), F.max("at")
    return rows.groupBy(*KEY).agg(
        F.count("*").alias("n"),
        end.alias("duration_ms"),
        F.when(end > 0, (end - start) / end * 100).alias("coverage_pct"),
        F.avg("speed").alias("avg_speed"),
        F.max("speed").alias("max_speed"),
        F.min("pos").alias("min_pos"),
        F.max("pos").alias("max_pos"),
        F.avg("dt").alias("avg_interval_ms"),
        count(fast).alias("n_fast"),
        count((F.col("dp") > 0) & (F.col("dp") < SMALL_MOVE)).alias("n_small"),
        count(F.col("dt") < CLOSE_MS).alias("n_close"),
        count((F.col("dt") > FAR_MS) & (F.col("dp") > SMALL_MOVE)).alias("n_far"),
    )


def quality_issues(points: DataFrame) -> DataFrame:
    """Rows ``(series_id, axis, category, severity, number, start, end)``; a series is empty only if it has no row here."""
    stats = quality_stats(points)
    none = F.lit(None).cast("long")
    row = lambda df, kind, level, n, a=none, z=none: df.select(
        *KEY, F.lit(kind).alias("category"), level.alias("severity"), n.cast("double").alias("number"), a.alias("start"), z.alias("end")
    )
    one, full = stats.where("n < 2"), stats.where("n >= 2")
    level = lambda n, error, warning: F.when(n > error, "ERROR").when(n > warning, "WARNING").otherwise("INFO")
    share = F.col("n_small") / (F.col("n") - 1) * 100
    wide = moves(points).where((F.col("dt") > FAR_MS) & (F.abs("dp") > SMALL_MOVE)).withColumn("_r", F.row_number().over(series()))
    dead = oscillation_runs(points, SMALL_MOVE, DEAD_MS)
    parts = [
        row(one, "insufficient", F.lit("ERROR"), F.col("n")),
        row(full.where("n_fast > 0"), "speed_limit", level(F.col("n_fast"), 50, 10), F.col("n_fast")),
        row(dead, "dead_zone", F.lit("INFO"), F.col("end") - F.col("start"), F.col("start"), F.col("end")),
        row(full.where("coverage_pct < 80"), "coverage", F.when(F.col("coverage_pct") < 50, "WARNING").otherwise("INFO"), F.col("coverage_pct")),
        row(full.where((share > 10) | (F.col("n_small") > 5)), "min_movement", F.when(share > 10, "WARNING").otherwise("INFO"), F.col("n_small")),
        row(full.where("n_close > 0"), "interval_close", F.lit("INFO"), F.col("n_close")),
        row(wide.where(F.col("_r") <= FAR_SHOWN), "interval_far", F.lit("WARNING"), F.col("dt"), F.col("at"), F.col("at") + F.col("dt")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quality_score(points: DataFrame) -> DataFrame:
    """100 less the penalties of all issues, from 0 to 100, truncated."""
    c, s = F.col("category"), F.col("severity")
    warning = F.when(c == "speed_limit", F.least(F.lit(30.0), F.col("number") / 2)).when(c == "coverage", 10).when(c == "min_movement", 5).when(c == "interval_far", 3).otherwise(2)
    error = F.when(c == "insufficient", 80).otherwise(20)
    cost = F.when(s == "ERROR", error).when(s == "WARNING", warning).otherwise(1)
    lost = quality_issues(points).groupBy(*KEY).agg(F.sum(cost).alias("lost"), F.max(c == "insufficient").alias("one"))
    every = points.select(*KEY).distinct().join(lost, list(KEY), "left")
    score = F.greatest(F.lit(0), F.floor(100 - F.coalesce("lost", F.lit(0)))).cast("int")
    return every.select(*KEY, F.when(F.col("one"), F.lit(10)).otherwise(score).alias("score"))


def classify_match(offset: Column, gap: Column, fps: float = 30.0) -> Column:
    frame = 1000.0 / fps if fps > 0 else 33.33
    out = F.when((offset < frame) & (gap < 3), "gold").when((offset < 66) & (gap < 7), "green")
    return out.when((offset < 133) & (gap < 15), "yellow").otherwise("red")


def comparison_metrics(main: DataFrame, ref: DataFrame) -> DataFrame:
    """MAE, correlation, speed MAE and coverage of each series that has two points of ``main`` in the overlap."""
    rows = interpolated_pairs(main, ref).withColumns(
        {"_dt": F.col("at") - F.lag("at").over(series()), "_dm": F.col("pos") - F.lag("pos").over(series()), "_dr": F.col("ref_value") - F.lag("ref_value").over(series())}
    )
    dt = F.when(F.col("_dt") > 0, F.col("_dt")).when(F.col("_dt").isNotNull(), F.lit(1))
    speed_gap = F.abs(F.abs("_dm") / dt * 1000 - F.abs("_dr") / dt * 1000)
    flat = (F.stddev_pop("pos") > 1e-9) & (F.stddev_pop("ref_value") > 1e-9)
    whole_ref = F.first(F.col("ref_end") - F.col("ref_start"))
    out = rows.groupBy(*KEY).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(F.col("pos") - F.col("ref_value"))).alias("mae"),
        F.when(flat, F.corr("pos", "ref_value")).otherwise(F.lit(0.0)).alias("correlation"),
        F.avg(speed_gap).alias("speed_mae"),
        F.when(whole_ref > 0, F.first(F.col("end") - F.col("start")) / whole_ref).otherwise(F.lit(0.0)).alias("coverage"),
    )
    return out.where("n >= 2")


def per_chapter_mae(main: DataFrame, ref: DataFrame, chapters: DataFrame) -> DataFrame:
    """MAE of each chapter (both bounds inclusive) with two compared points or more."""
    rows = intervals_of(interpolated_pairs(main, ref), chapters.where("end_ms > start_ms"))
    out = rows.groupBy(*KEY, "chapter_id").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("pos") - F.col("ref_value"))).alias("mae"))
    return out.where("n >= 2")


def problem_sections(main: DataFrame, ref: DataFrame, window: int = 500, limit: float = 20, gap: int = 300) -> DataFrame:
    """Windows (half-step apart, two points at least) whose mean error is over ``limit``, merged where ``gap`` ms or less apart."""
    step = window // 2
    rows = interpolated_pairs(main, ref).where(F.col("end") - F.col("start") >= window)
    since = F.col("at") - F.col("start")
    last = F.floor((F.col("end") - F.col("start") - window) / step)
    low, high = F.greatest(F.lit(0), F.ceil((since - window) / step)), F.least(last, F.floor(since / step))
    rows = rows.where(low <= high).withColumn("k", F.explode(F.sequence(low, high)))
    bad = rows.groupBy(*KEY, "k").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("pos") - F.col("ref_value"))).alias("mae"), F.first("start").alias("_s"))
    bad = bad.where((F.col("n") >= 2) & (F.col("mae") > limit)).withColumn("from", F.col("_s") + F.col("k") * step)
    order = Window.partitionBy(*KEY).orderBy("from")
    new = F.coalesce((F.col("from") - (F.lag("from").over(order) + window) > gap).cast("int"), F.lit(1))
    bad = bad.withColumn("_new", new).withColumn("section", F.sum("_new").over(order))
    return bad.groupBy(*KEY, "section").agg(F.min("from").alias("start_ms"), (F.max("from") + window).alias("end_ms"), F.avg("mae").alias("mae"))


#: Milliseconds of a block of impulses that is transformed at once; up to as many pairs are counted one by one.
LAG_BLOCK = 1 << 20


def _correlation_peak(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """The lag ``a - b`` (times in ms) that most pairs have, the least of equally common ones, and how many have it.

    Both impulse trains are cut into blocks; blocks that lie equally far apart add up before they are transformed back, and
    where the lags of two such sums overlap these are added. Correlations are counts, so rounding makes them exact. Few pairs need no blocks.
    """
    size = LAG_BLOCK
    if len(a) * len(b) <= size:
        lags, hits = np.unique(np.subtract.outer(a, b), return_counts=True)
        return int(lags[hits.argmax()]), int(hits.max())

    def spectra(t: np.ndarray) -> dict[int, np.ndarray]:
        out = {}
        for k in np.unique(t // size).tolist():
            train = np.bincount(t[t // size == k] - k * size, minlength=2 * size).astype(np.float32)
            out[k] = np.fft.rfft(train)
        return out

    fa, fb = spectra(a), spectra(b)
    best, tail = (0, 0), None
    for d in range(min(fa) - max(fb), max(fa) - min(fb) + 2):
        pairs = [fa[k] * fb[k - d].conj() for k in fa if k - d in fb]
        # lags from -size to size around d blocks; the lower half meets the upper half of the sum before
        both = np.rint(np.fft.irfft(sum(pairs), 2 * size)) if pairs else np.zeros(2 * size)
        lower = both[size:] + (0 if tail is None else tail)
        tail = both[:size]
        at = int(lower.argmax())
        if lower[at] > best[1]:
            best = ((d - 1) * size + at, int(lower[at]))
    return best


def signal_offset(main: DataFrame, ref: DataFrame, least: int = 5, prominence: float = 5) -> DataFrame:
    """The lag (ms, any) at which most prominent extrema of both series meet, ties to the smallest, and their number.

    Series with under ``least`` extrema on a side have no row. A series is correlated in one task, by its pairs if they are few, else in
    blocks, which need 16 bytes for each millisecond of those that hold extrema.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "seq"], kind="stable")
        times = []
        for side in (0, 1):
            own = rows[rows["side"] == side]
            y = own["pos"].to_numpy(dtype=float)
            found = np.union1d(find_peaks(y, prominence=prominence), find_peaks(-y, prominence=prominence)).astype(int)
            times.append(own["at"].to_numpy()[found])
        if min(map(len, times)) < least:
            return pd.DataFrame({c: pd.Series(dtype="object") for c in (*KEY, "lag", "hits")}).astype({"lag": "int64", "hits": "int64"})
        lag, hits = _correlation_peak(*times)
        return pd.DataFrame({**{c: [rows[c].iloc[0]] for c in KEY}, "lag": [lag], "hits": [hits]})

    both = main.select(*KEY, "at", "seq", "pos", F.lit(0).alias("side")).unionByName(ref.select(*KEY, "at", "seq", "pos", F.lit(1).alias("side")))
    kind = {f.name: f.dataType.simpleString() for f in main.schema}
    return grouped(both, KEY, run, ", ".join(f"{c} {kind[c]}" for c in KEY) + ", lag long, hits long")


def heatmap_buckets(points: DataFrame, width: int, duration: int) -> DataFrame:
    """Speed of the segment that covers the centre of each of ``width`` columns; 0 where there is none."""
    seg = points.select(*KEY, "at", "pos", "seq", F.lead("at").over(series()).alias("_e"), F.lead("pos").over(series()).alias("_q"))
    step = duration / width
    low = F.greatest(F.lit(0), F.ceil(F.col("at") / step - 0.5)).cast("long")
    high = F.least(F.lit(width - 1), F.ceil(F.col("_e") / step - 0.5) - 1).cast("long")
    speed = F.abs(F.col("_q") - F.col("pos")) / (F.col("_e") - F.col("at")) * 1000
    hit = seg.where(F.col("_e") > F.col("at")).withColumns({"_l": low, "_h": high, "speed": speed}).where("_l <= _h")
    hit = hit.select(*KEY, F.explode(F.sequence("_l", "_h")).alias("col"), "speed")
    every = points.select(*KEY).distinct().withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1)).cast("array<bigint>")))
    return every.join(hit, [*KEY, "col"], "left").select(*KEY, "col", F.coalesce("speed", F.lit(0.0)).alias("speed"))


def envelope_buckets(points: DataFrame, width: int, duration: int) -> DataFrame:
    """Lowest and highest position of each column that a segment passes, both of its ends included."""
    seg = points.select(*KEY, "at", "pos", "seq", F.coalesce(F.lead("at").over(series()), F.col("at")).alias("_e"), F.coalesce(F.lead("pos").over(series()), F.col("pos")).alias("_q"))
    col = lambda c: F.least(F.lit(width - 1), F.floor(F.col(c) * width / duration)).cast("long")
    seg = seg.withColumns({"_l": col("at"), "_h": col("_e")})
    rows = seg.select(*KEY, F.explode(F.sequence("_l", "_h")).alias("col"), F.least("pos", "_q").alias("lo"), F.greatest("pos", "_q").alias("hi"))
    return rows.groupBy(*KEY, "col").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def waveform_peaks(samples: DataFrame, step: int) -> DataFrame:
    """Largest absolute ``value`` of every full bucket of ``step`` samples ``(series_id, i, value)``."""
    out = samples.groupBy("series_id", F.floor(F.col("i") / step).cast("long").alias("bucket")).agg(F.max(F.abs("value")).alias("peak"), F.count("*").alias("n"))
    return out.where(F.col("n") == step).drop("n")


def filter_preview(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a point-wise filter changes in each series: points, clamped ends, ranges, mean change."""
    b = before.select(*KEY, "seq", F.col("pos").alias("was"))
    rows = b.join(after.select(*KEY, "seq", "pos"), [*KEY, "seq"])
    hit = F.col("pos") != F.col("was")
    return rows.groupBy(*KEY).agg(
        F.count("*").alias("points"),
        F.count(F.when(hit, 1)).alias("affected"),
        F.count(F.when(hit & F.col("pos").isin(0, 100), 1)).alias("clamped"),
        F.min("was").alias("min_before"),
        F.max("was").alias("max_before"),
        F.min("pos").alias("min_after"),
        F.max("pos").alias("max_after"),
        F.avg(F.abs(F.col("pos") - F.col("was"))).alias("mean_change"),
    )
