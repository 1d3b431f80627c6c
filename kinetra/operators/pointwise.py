"""Operators that change or drop points one by one. A selection restricts the change; other points stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra.functions.numbers import frame_to_ms
from kinetra.schema import KEY, clip, series, to_pos, whole


def _where(df: DataFrame, column: str, value: Column, selected: Column | None) -> DataFrame:
    return df.withColumn(column, value if selected is None else F.when(selected, value).otherwise(F.col(column)))


def amplify(df: DataFrame, scale: float = 1.25, centre: float = 50, selected: Column | None = None) -> DataFrame:
    return _where(df, "pos", to_pos(centre + (F.col("pos") - centre) * F.lit(float(scale))), selected)


def invert(df: DataFrame, selected: Column | None = None) -> DataFrame:
    return _where(df, "pos", (100 - F.col("pos")).cast("int"), selected)


def threshold_clamp(df: DataFrame, lower: int = 20, upper: int = 80, selected: Column | None = None) -> DataFrame:
    """Positions under ``lower`` become 0, above ``upper`` 100."""
    if lower >= upper:
        raise ValueError("lower must be less than upper")
    value = F.when(F.col("pos") < lower, 0).when(F.col("pos") > upper, 100).otherwise(F.col("pos")).cast("int")
    return _where(df, "pos", value, selected)


def value_clamp(df: DataFrame, value: int = 50, selected: Column | None = None) -> DataFrame:
    return _where(df, "pos", clip(F.lit(value)).cast("int"), selected)


def nudge_value(df: DataFrame, delta: int, grid: int = 1, selected: Column | None = None) -> DataFrame:
    return _where(df, "pos", clip(F.col("pos") + delta * max(grid, 1)).cast("int"), selected)


def time_shift(df: DataFrame, delta: int) -> DataFrame:
    """Add ``delta`` ms; points that would come before 0 go."""
    return df.withColumn("at", F.col("at") + delta).where("at >= 0")


def shift_series_time(df: DataFrame, delta: int) -> DataFrame:
    """Add ``delta`` ms, but no more to the left than keeps the first point at 0."""
    return df.withColumn("at", F.col("at") + F.greatest(F.lit(delta), -F.min("at").over(whole())))


def nudge_frames(df: DataFrame, frames: int, fps: float, chapters: DataFrame | None = None) -> DataFrame:
    """Shift by signed frames, never under 0; with ``chapters(series_id, start_ms, end_ms)`` only points in one."""
    ms = F.signum(F.lit(frames)) * frame_to_ms(F.lit(abs(frames)), fps)
    moved = F.greatest(F.lit(0), F.col("at") + ms).cast("long")
    if chapters is None:
        return df.withColumn("at", moved)
    spans = chapters.select(F.col("series_id").alias("c_series"), "start_ms", "end_ms")
    inside = (F.col("series_id") == F.col("c_series")) & F.col("at").between(F.col("start_ms"), F.col("end_ms"))
    hit = df.join(spans, inside, "left_semi").withColumn("at", moved)
    return hit.unionByName(df.join(spans, inside, "left_anti"))


def in_range(df: DataFrame, start: int, end: int) -> DataFrame:
    return df.where(F.col("at").between(start, end))


def in_box(df: DataFrame, start: int, end: int, low: int, high: int) -> DataFrame:
    return df.where(F.col("at").between(start, end) & F.col("pos").between(low, high))


def snap_to_grid(df: DataFrame, step: float, offset: float = 0.0) -> DataFrame:
    """Times to the nearest of ``offset + k * step`` ms."""
    nearest = F.rint((F.col("at") - offset) / F.lit(float(step))) * F.lit(float(step)) + offset
    return df.withColumn("at", F.greatest(F.lit(0), F.rint(nearest)).cast("long"))


def beat_step(bpm: float, subdivision: int) -> float:
    return 60000.0 / bpm / subdivision


def clear_points(df: DataFrame, gone: Column, axis: str | None = None) -> DataFrame:
    """Drop points where ``gone`` holds, on one axis or all."""
    return df.where(~(gone if axis is None else gone & (F.col("axis") == axis)))


def relative_to(df: DataFrame, t: int, before: bool = True) -> DataFrame:
    return df.where(F.col("at") <= t if before else F.col("at") >= t)


def isolate(df: DataFrame, selected: Column) -> DataFrame:
    """Between the first and the last selected point keep only selected ones; nothing changes under two."""
    at = F.when(selected, F.struct("at", "seq"))
    marked = df.withColumns({"_a": F.min(at).over(whole()), "_b": F.max(at).over(whole())})
    inside = F.struct("at", "seq").between(F.col("_a"), F.col("_b"))
    return marked.where(F.coalesce(~inside | selected, F.lit(True))).drop("_a", "_b")


def apply_pattern(starts: DataFrame, pattern: DataFrame, speed: float = 1.0, amplitude: float = 1.0) -> DataFrame:
    """Points of ``pattern(name, at, pos)`` from each row of ``starts(series_id, axis, name, start)`` on."""
    at = F.rint(F.col("start") + F.col("p.at") / F.lit(max(float(speed), 0.1))).cast("long")
    pos = to_pos(50 + (F.col("p.pos") - 50) * F.lit(float(amplitude)))
    return starts.alias("s").join(pattern.alias("p"), "name").select(*[f"s.{k}" for k in KEY], "name", at.alias("at"), pos.alias("pos"))


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with ``n``, the place of each point in its series, from 1."""
    return df.withColumn("n", F.row_number().over(series()))
