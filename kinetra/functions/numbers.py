"""Scalar expressions: frames and times, timecodes, colours, axis names, pose angles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinetra.schema import AXES, clip, rint


def frame_to_ms(frame: Column, fps: float) -> Column:
    """Half-even ms of a frame; 0 for negative frames or rates that are not positive."""
    return F.when((frame >= 0) & F.lit(fps > 0), rint(frame / F.lit(float(fps or 1)) * 1000)).otherwise(F.lit(0).cast("long"))


def ms_to_frame(ms: Column, fps: float) -> Column:
    return F.when((ms >= 0) & F.lit(fps > 0), rint(ms * F.lit(float(fps)) / 1000)).otherwise(F.lit(0).cast("long"))


def snap_to_frame(ms: Column, fps: float) -> Column:
    """The time of the nearest frame."""
    return frame_to_ms(ms_to_frame(ms, fps), fps)


def timecode(frame: Column, fps: float) -> Column:
    """``HH:MM:SS.mmm`` by floors; negative frames count as 0."""
    if fps <= 0:
        return F.lit("00:00:00.000")
    s = F.greatest(frame, F.lit(0)) / F.lit(float(fps))
    part = lambda c: F.floor(c).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", part(s / 3600), part(s % 3600 / 60), part(s % 60), part((s - F.floor(s)) * 1000))


def timecode_frames(text: Column, fps: float) -> Column:
    """Frame of ``HH:MM:SS[.mmm]``; 0 where the text is no timecode."""
    parts = F.split(text, ":")
    seconds = F.split(F.try_element_at(parts, F.lit(3)), r"\.")
    whole = lambda c: c.try_cast("long")
    ms = F.when(F.size(seconds) == 1, F.lit(0)).when(F.size(seconds) == 2, whole(F.try_element_at(seconds, F.lit(2))))
    total = whole(parts[0]) * 3600 + whole(F.try_element_at(parts, F.lit(2))) * 60 + whole(seconds[0]) + ms / 1000.0
    found = F.when(F.size(parts) == 3, rint(total * F.lit(float(fps))))
    return F.coalesce(found if fps > 0 else F.lit(None).cast("long"), F.lit(0).cast("long"))


def time_input_frames(text: Column, fps: float) -> Column:
    """Frame of a free time: ``[H:]M:S[.f]``, seconds with a dot, or a frame number; -1 where it is none."""
    t = F.trim(text)
    parts = F.split(t, ":")
    n = F.size(parts)
    last = F.element_at(parts, -1)
    seconds = F.when(last.contains("."), last.try_cast("double")).otherwise(last.try_cast("long").cast("double"))
    whole = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("long")
    total = F.when(n == 1, F.when(t.contains("."), seconds)).when(n == 2, whole(1) * 60 + seconds).when(n == 3, whole(1) * 3600 + whole(2) * 60 + seconds)
    frame = F.when((n == 1) & ~t.contains("."), t.try_cast("long")).otherwise(rint(total * F.lit(float(fps))))
    return F.coalesce(frame if fps > 0 else F.lit(None).cast("long"), F.lit(-1).cast("long"))


def _axis_map(key: int, value: int) -> Column:
    return F.create_map(*[F.lit(x) for a in AXES for x in (a[key], a[value])])


def axis_suffix(axis: Column) -> Column:
    """File suffix of an axis; ``.name`` for one that the registry lacks."""
    return F.coalesce(F.try_element_at(_axis_map(0, 1), axis), F.concat(F.lit("."), axis))


def axis_code(axis: Column) -> Column:
    return F.try_element_at(_axis_map(0, 2), axis)


def axis_of_code(code: Column) -> Column:
    return F.try_element_at(_axis_map(2, 0), code)


def axis_of_suffix(suffix: Column) -> Column:
    return F.when(suffix != "", F.try_element_at(_axis_map(1, 0), suffix))


#: Fixed values of the heat map: share of the maximum speed, then red, green, blue, alpha.
SPEED_STOPS = (
    (0.00, (0.30, 0.35, 0.50, 1.0)),
    (0.05, (0.20, 0.45, 0.90, 1.0)),
    (0.20, (0.0, 0.9, 0.9, 1.0)),
    (0.40, (0.0, 0.8, 0.2, 1.0)),
    (0.65, (0.9, 0.9, 0.1, 1.0)),
    (1.00, (0.9, 0.1, 0.1, 1.0)),
)
OVERSPEED = (0.78, 0.45, 0.95, 1.0)


def speed_colour(speed: Column, most: float = 400.0) -> dict[str, Column]:
    """Red, green, blue and alpha of a speed: linear between stops, one colour beyond ``most``."""
    s = F.abs(speed)
    t = s / F.lit(float(most))
    out = {}
    for k, name in enumerate(("r", "g", "b", "a")):
        c = F.when(s > most, F.lit(OVERSPEED[k]))
        for (p, low), (q, high) in zip(SPEED_STOPS, SPEED_STOPS[1:], strict=False):
            part = F.lit(low[k]) + F.lit(high[k] - low[k]) * (t - p) / (q - p)
            c = c.when(t < q, part) if q < 1 else c.otherwise(part)
        out[name] = c
    return out


#: Places of the shoulders and hips among the 17 keypoints: left and right.
SHOULDERS, HIPS = (5, 6), (11, 12)


def pose_angles(points: Column, least: float = 0.3) -> dict[str, Column]:
    """Roll, pitch, twist (degrees) and sway of an array of (x, y, conf); null where confidence is under ``least``."""
    at = lambda i: points[i]
    ls, rs, lh, rh = (at(i) for i in (*SHOULDERS, *HIPS))
    hips = F.least(lh["conf"], rh["conf"]) >= least
    both = hips & (F.least(ls["conf"], rs["conf"]) >= least)
    mid = lambda a, b, c: (a[c] + b[c]) / 2
    line = lambda a, b: F.atan2(b["y"] - a["y"], b["x"] - a["x"])
    twist = line(ls, rs) - line(lh, rh)
    twist = F.when(twist > math.pi, twist - 2 * math.pi).when(twist < -math.pi, twist + 2 * math.pi).otherwise(twist)
    lean = F.atan2(mid(ls, rs, "x") - mid(lh, rh, "x"), -(mid(ls, rs, "y") - mid(lh, rh, "y")))
    return {
        "roll": F.when(hips, F.degrees(line(lh, rh))),
        "pitch": F.when(both, F.degrees(lean)),
        "twist": F.when(both, F.degrees(twist)),
        "sway": F.when(both, mid(lh, rh, "x") - mid(ls, rs, "x")),
    }


def angle_to_pos(angle: Column, centre: float = 0.0, span: float = 45.0) -> Column:
    return clip(rint(((angle - centre) / max(0.1, span) + 0.5) * 100)).cast("int")
