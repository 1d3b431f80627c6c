"""A registry of filters with parameter specs, pipelines of them, and presets.

A filter takes and returns a table of points. Users add their own: a function on the pandas rows of one
series (``register_filter``), which runs for every series of the cluster's table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetra.operators import compound, pointwise, sequential, windows
from kinetra.operators.scope import at_points, in_slice
from kinetra.schema import KEY


@dataclass(frozen=True)
class Param:
    kind: type
    default: Any
    low: float | None = None
    high: float | None = None
    choices: tuple = ()

    def checked(self, name: str, value: Any) -> Any:
        if not isinstance(value, self.kind) and not (self.kind is float and isinstance(value, int)):
            raise ValueError(f"{name} must be {self.kind.__name__}")
        if self.choices and value not in self.choices:
            raise ValueError(f"{name} must be one of {', '.join(map(str, self.choices))}")
        if (self.low is not None and value < self.low) or (self.high is not None and value > self.high):
            raise ValueError(f"{name} must be from {self.low} to {self.high}")
        return value


@dataclass(frozen=True)
class Filter:
    name: str
    apply: Callable[..., DataFrame]
    params: dict[str, Param] = field(default_factory=dict)

    def __call__(self, points: DataFrame, **given: Any) -> DataFrame:
        unknown = given.keys() - self.params.keys()
        if unknown:
            raise ValueError(f"{self.name} has no parameter {', '.join(sorted(unknown))}")
        return self.apply(points, **{k: p.checked(k, given.get(k, p.default)) for k, p in self.params.items()})


_FILTERS: dict[str, Filter] = {}


def add(name: str, apply: Callable[..., DataFrame], **params: Param) -> None:
    _FILTERS[name] = Filter(name, apply, params)


def register_filter(name: str, fn: Callable[..., pd.DataFrame], **params: Param) -> None:
    """``fn(rows, **params)`` gets the rows of one series in time order and returns rows of the same columns."""
    if name in _FILTERS:
        raise ValueError(f"there is a filter {name} already")
    add(name, lambda points, **given: sequential.per_series(points, lambda rows: fn(rows, **given)), **params)


def filters(contains: str = "") -> list[str]:
    return sorted(n for n in _FILTERS if contains.lower() in n)


def get(name: str) -> Filter:
    if name not in _FILTERS:
        raise KeyError(f"no filter {name}; there are {', '.join(filters())}")
    return _FILTERS[name]


@dataclass(frozen=True)
class Step:
    """A filter with its parameters, on all points or on those that ``selected`` holds for, or within ``between`` (ms, ends included).

    A selection wins over a range. A filter that changes each point by itself changes the selected points only; any other works on
    the slice from the first to the last of them as if it were the whole series.
    """

    filter: str
    params: dict[str, Any] = field(default_factory=dict)
    enabled: bool = True
    selected: Column | None = None
    between: tuple[int, int] | None = None

    def __call__(self, points: DataFrame) -> DataFrame:
        chosen = self.selected if self.selected is not None else F.col("at").between(*self.between) if self.between else None
        run = lambda rows: get(self.filter)(rows, **self.params)
        if chosen is None:
            return run(points)
        return (at_points if self.filter in POINTWISE else in_slice)(points, chosen, run)


#: Filters that look at one point at a time.
POINTWISE = frozenset(("amplify", "invert", "threshold_clamp", "value_clamp", "time_shift"))


def run_pipeline(points: DataFrame, steps: list[Step], axis: str | None = None) -> tuple[DataFrame, list[str]]:
    """Apply the enabled steps in order to one axis or all; a step that can't be built is reported and left out."""
    rest = None if axis is None else points.where(F.col("axis") != axis)
    out = points if axis is None else points.where(F.col("axis") == axis)
    errors = []
    for i, step in enumerate(s for s in steps if s.enabled):
        try:
            out = step(out)
        except (KeyError, ValueError) as e:
            errors.append(f"step {i + 1} ({step.filter}): {e.args[0]}")
    return (out if rest is None else out.unionByName(rest)), errors


N = lambda default, low, high: Param(float, float(default), low, high)
I = lambda default, low, high: Param(int, default, low, high)  # noqa: E731, E741


def numbered(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A filter that makes new points, whose rows are numbered anew in time order."""

    def run(points: DataFrame, **given: Any) -> DataFrame:
        order = Window.partitionBy(*KEY).orderBy("at", "pos")
        return fn(points, **given).withColumn("seq", (F.row_number().over(order) - 1).cast("long"))

    return run


add("resample_peaks", numbered(sequential.resample_peaks), step=I(50, 10, 1000))
add("inject_points", numbered(sequential.inject_points), interval=N(100, 10, 10_000), adaptive=Param(bool, True), method=Param(str, "linear", choices=("linear", "cosine", "cubic")))
add("amplify", pointwise.amplify, scale=N(1.25, 0, 5), centre=N(50, 0, 100))
add("invert", pointwise.invert)
add("threshold_clamp", pointwise.threshold_clamp, lower=I(20, 0, 100), upper=I(80, 0, 100))
add("value_clamp", pointwise.value_clamp, value=I(50, 0, 100))
add("time_shift", pointwise.time_shift, delta=I(0, -3_600_000, 3_600_000))
add("dynamic_amplify", windows.dynamic_amplify, window_ms=I(4000, 500, 10_000), min_range=I(5, 1, 50))
add("savgol", windows.savgol, window=I(7, 3, 99), degree=I(3, 1, 9))
add("fit_range", windows.fit_range, low=I(0, 0, 100), high=I(100, 0, 100))
add("range_extend", windows.range_extend, amount=N(10, 0, 100))
add("moving_normalize", windows.moving_normalize, window=I(7, 3, 99), span=N(50, 1, 100))
add("detrend", windows.detrend, sample=I(4, 1, 50))
add("align_peaks", windows.align_peaks)
add("align_top_bottom", windows.align_top_bottom, mode=Param(str, "top", choices=("top", "bottom")))
add("min_interval", sequential.min_interval_filter, gap=I(10, 0, 10_000))
add("rdp_simplify", sequential.rdp_simplify, tolerance=N(8, 0, 1000), auto_scale=Param(bool, True))
add("keyframes", sequential.keyframes, tolerance=N(10, 0, 100))
add("anti_jerk", sequential.anti_jerk, jerk=N(20, 5, 50), main=N(50, 20, 100), deviation=N(15, 5, 50))
add("speed_limit", sequential.speed_limit, gap=I(60, 0, 1000), vibe=I(0, 0, 100), speed=N(500, 1, 10_000))
add("directional_speed_limit", sequential.directional_speed_limit, speed=N(600, 1, 10_000), bias=Param(str, "symmetric", choices=("symmetric", "top", "bottom")))
add(
    "ultimate_autotune", compound.ultimate_autotune, scale=N(1.2, 0.5, 3), centre=N(50, 0, 100), speed=N(800, 100, 5000), jerk=N(15, 3, 50), amplitude=N(10, 1, 50),
    tolerance=N(15, 0.5, 30),
)
add("online_simplify", sequential.online_simplify, tolerance=N(2, 0, 50))
add("visvalingam_simplify", sequential.visvalingam_simplify, area=N(2, 0, 10_000))
add("savgol_unsaturated", compound.savgol_unsaturated, low=N(1, 0, 100), high=N(99, 0, 100), longest=I(15, 3, 99), degree=I(2, 0, 5))
add("savgol_autotune", compound.savgol_autotune, longest=I(9, 3, 99), degree=I(3, 0, 5))

PRESETS: dict[str, list[Step]] = {
    "clean": [Step("min_interval"), Step("savgol", {"window": 5, "degree": 2}), Step("keyframes", {"tolerance": 8.0})],
    "device": [Step("anti_jerk"), Step("speed_limit", {"speed": 400.0}), Step("threshold_clamp", {"lower": 5, "upper": 95})],
    "full": [Step("ultimate_autotune"), Step("dynamic_amplify"), Step("speed_limit")],
}
