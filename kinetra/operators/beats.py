"""From beat times to motion: the grid of beats is cleaned and made regular, then played with the energy of the sound.

Times are in seconds. A series' beats are one group: whether a beat stays, or where it goes, depends on those before it.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: A beat is spurious under this share of its section's gap; a gap over this many usual ones has lost beats.
SPURIOUS, LOST = 0.4, 1.8

Energy = Callable[[float], float]


def _middle(ordered: list[float]) -> float:
    """The median of a sorted list; for few values faster than an array's."""
    n = len(ordered)
    return ordered[n // 2] if n % 2 else (ordered[n // 2 - 1] + ordered[n // 2]) / 2


def sections(gaps: np.ndarray, first: int = 6, change: float = 0.4) -> list[tuple[int, int, float]]:
    """Stretches of steady tempo ``(start, end, median gap)``: ``first`` gaps, and those after that differ by less than ``change``."""
    out, start, gaps = [], 0, gaps.tolist()
    while start < len(gaps):
        end = min(start + first, len(gaps))
        ordered = sorted(gaps[start:end])
        while end < len(gaps) and abs(gaps[end] - _middle(ordered)) < change * _middle(ordered):
            insort(ordered, gaps[end])
            end += 1
        out.append((start, end, _middle(ordered)))
        start = end
    return out


def without_spurious(t: np.ndarray) -> np.ndarray:
    """Beats but those that come too soon after the one before, by the tempo of their section."""
    gaps = np.diff(t)
    usual = np.concatenate([np.full(z - a, m) for a, z, m in sections(gaps)] or [gaps])
    return t[np.append(True, gaps >= SPURIOUS * usual)]


def filled(t: np.ndarray, energy: Energy, silence: float) -> np.ndarray:
    """Beats with even ones in the gaps that have lost some, where the sound is not silent."""
    t = t.tolist()
    gaps, out = [z - a for a, z in zip(t, t[1:], strict=False)], [t[0]]
    for i, gap in enumerate(gaps):
        usual = _middle(sorted(gaps[max(0, i - 4) : i + 4]))
        n = round(gap / usual) if usual > 0 and gap > LOST * usual else 1
        between = [t[i] + k * (gap / n) for k in range(1, n)]
        out += [x for x in between if energy(x) > silence] + [t[i + 1]]
    return np.array(out)


def with_midpoints(t: np.ndarray) -> np.ndarray:
    """Beats with a point halfway to the next one, after the last at half the gap before it."""
    if len(t) < 2:
        return t
    half = np.diff(t) / 2
    return np.column_stack([t, t + np.append(half, half[-1])]).ravel()


def regular(t: np.ndarray, reach: int = 8, near: float = 0.3) -> np.ndarray:
    """Times moved to one usual gap after the time before as it came out, unless they lie ``near`` of a gap or more off."""
    gaps, t = np.diff(t).tolist(), t.tolist()
    out = t[:1]
    for i in range(1, len(t)):
        usual = _middle(sorted(gaps[max(0, i - reach) : i + reach - 1]))
        wanted = out[-1] + usual
        out.append(wanted if usual > 0 and abs(t[i] - wanted) < near * usual else t[i])
    return np.array(out)


def clean_beats(t: np.ndarray, energy: Energy = lambda _: 1.0, silence: float = 0.05) -> np.ndarray:
    """Times of the points to play for sorted beat times: see the steps above. Fewer than three beats stay as they are."""
    if len(t) < 3:
        return t
    t = without_spurious(t)
    if len(t) < 2:
        return t
    t = with_midpoints(filled(t, energy, silence))
    return regular(t) if len(t) > 4 else t


def swings(t: np.ndarray, energy: np.ndarray, most: float = 100, least: float = 60, speed: float = 600, smooth: int = 16) -> np.ndarray:
    """Half the swing of every point: by its energy, no farther than ``speed`` allows, evened over ``smooth`` points (mirrored ends)."""
    half = (least + (most - least) * energy) / 2
    for i, gap in enumerate(np.diff(t).tolist()):
        if gap >= 0.001 and half[i] > speed * gap / 2:
            half[i : i + 2] = np.minimum(half[i : i + 2], speed * gap / 2)
    if len(half) <= smooth // 2:
        return half
    wide = np.pad(half, (smooth // 2, smooth - 1 - smooth // 2), mode="symmetric")
    return np.convolve(wide, np.full(smooth, 1 / smooth), mode="valid")


def play(t: np.ndarray, envelope: np.ndarray, hop: float, most: float = 100, least: float = 60, speed: float = 600, silence: float = 0.05) -> list[tuple[int, int]]:
    """Points ``(ms, position)`` below and above the middle by turns; silent ones are left out, of equal times the last stays."""
    at = lambda x: float(envelope[min(int(x / hop), len(envelope) - 1)]) if len(envelope) and x >= 0 else 0.5
    t = clean_beats(t, at, silence)
    if not len(t):
        return []
    energy = np.array([at(x) for x in t])
    half = swings(t, energy.copy(), most, least, speed)
    heard = np.flatnonzero(energy >= silence)
    way = np.where(np.arange(len(heard)) % 2 == 0, -1, 1)
    pos = np.clip(np.rint(50 + way * half[heard]), 0, 100).astype(int)
    return sorted(dict(zip(np.rint(t[heard] * 1000).astype(int).tolist(), pos.tolist(), strict=True)).items())


def beats_to_points(beats: DataFrame, envelope: DataFrame, hop: float, most: float = 100, least: float = 60, speed: float = 600, silence: float = 0.05) -> DataFrame:
    """Points ``(series_id, at, pos)`` from beats ``(series_id, t)`` and the envelope ``(series_id, hop, energy)`` of ``hop`` seconds.

    Hops are numbered from 0; one that is missing has no energy. A series without an envelope is played at half energy.
    """

    def run(b: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(b):
            loud = np.zeros(int(e["hop"].max()) + 1 if len(e) else 0)
            loud[e["hop"].to_numpy(int)] = e["energy"].to_numpy(float)
            found = play(np.unique(b["t"].to_numpy(float)), loud, hop, most, least, speed, silence)
        key = (b if len(b) else e)["series_id"].iloc[0]
        return pd.DataFrame({"series_id": key, "at": [a for a, _ in found], "pos": [p for _, p in found]}).astype({"series_id": "int64", "at": "int64", "pos": "int32"})

    return beats.groupBy("series_id").cogroup(envelope.groupBy("series_id")).applyInPandas(run, "series_id long, at long, pos int")
