"""Column names, types and the axis registry of motion series.

A point is a row ``(series_id, axis, at, pos, seq)``: time in ms from the start, position 0 to 100, and a
number that orders rows of equal time. A series is the points of one ``(series_id, axis)``.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ("series_id", "axis")

POINTS = T.StructType(
    [
        T.StructField("series_id", T.LongType()),
        T.StructField("axis", T.StringType()),
        T.StructField("at", T.LongType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("seq", T.LongType()),
    ]
)

#: Fixed values of the file format: axis, file suffix, device code.
AXES = (
    ("stroke", "", "L0"),
    ("roll", ".roll", "R1"),
    ("pitch", ".pitch", "R2"),
    ("twist", ".twist", "R0"),
    ("sway", ".sway", "L1"),
    ("surge", ".surge", "L2"),
    ("vib", ".vib", "V0"),
    ("pump", ".pump", "V1"),
)


def series() -> WindowSpec:
    """Points of a series in time order; every operator uses this one window, so that plans share its sort."""
    return Window.partitionBy(*KEY).orderBy("at", "seq")


def whole() -> WindowSpec:
    return Window.partitionBy(*KEY)


def rint(c: Column) -> Column:
    """Round half to even, as a long."""
    return F.rint(c).cast("long")


def clip(c: Column, low: int = 0, high: int = 100) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def to_pos(c: Column) -> Column:
    """Round half to even and limit to 0 to 100."""
    return clip(F.rint(c)).cast("int")
