"""Filters on a part of each series: selected points, or the slice from the first to the last of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra.schema import series, whole

Run = Callable[[DataFrame], DataFrame]


def at_points(df: DataFrame, selected: Column, run: Run) -> DataFrame:
    """``run`` on the selected points only; a null selection is none. The other points stay."""
    chosen = F.coalesce(selected, F.lit(False))
    changed = run(df.where(chosen))
    return changed.unionByName(df.where(~chosen).select(changed.columns))


def in_slice(df: DataFrame, selected: Column, run: Run, least: int = 1) -> DataFrame:
    """``run`` on all points from the first selected one of a series to the last, as if they were the whole series.

    What lies before and after stays, and so does a series with fewer than ``least`` selected points.
    """
    chosen = F.coalesce(selected, F.lit(False))
    rows = df.withColumns({"_n": F.row_number().over(series()), "_s": chosen})
    place = F.when(F.col("_s"), F.col("_n"))
    rows = rows.withColumns({"_a": F.min(place).over(whole()), "_z": F.max(place).over(whole()), "_k": F.count(place).over(whole())})
    inside = F.coalesce(F.col("_n").between(F.col("_a"), F.col("_z")) & (F.col("_k") >= least), F.lit(False))
    changed = run(rows.where(inside).select(df.columns))
    return changed.unionByName(rows.where(~inside).select(changed.columns))


