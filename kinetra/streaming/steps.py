"""Steps of the live operators: small states that take one value after another.

A step's ``feed(t, v)`` returns the output of one value, or None. A step whose outputs come later than their values has
``rows(t, seq, v)``, the output rows that a value settles, and ``rest()``, those that the end of the series does. Batch and stream use
the same steps, so their results agree for values that come in order within the watermark.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np

from kinetra.operators.kernels import redundant


class RateLimit:
    """Values at least ``1000 / per_second`` ms apart, their time corrected by ``delay`` ms."""

    def __init__(self, per_second: float = 60, delay: float = 0) -> None:
        self.gap, self.delay, self.last = 1000.0 / per_second, delay, None

    def feed(self, t: float, v: float) -> float | None:
        t -= self.delay
        if self.last is not None and t - self.last < self.gap:
            return None
        self.last = t
        return float(min(100, max(0, round(v))))


class Ingest:
    """Live points to a clean series: snapped to frames, limited to 0 to 100, spaced, and simplified as they come.

    A point is new if it comes ``gap`` ms after the last one. One at the same time updates the last one in place; a nearer one
    goes. Of three last points the middle one goes if it is no strict extremum and lies within ``tolerance`` of the line of the others.
    A point is settled, and comes out, when its successor has been taken and has not displaced it.
    """

    def __init__(self, gap: float = 10, fps: float = 0, tolerance: float = 2) -> None:
        self.gap, self.fps, self.tolerance = gap, fps, tolerance
        self.before: tuple[int, int] | None = None
        self.last: tuple[int, int, int] | None = None

    def _snapped(self, t: int) -> int:
        if self.fps <= 0:
            return t
        return round(round(t * self.fps / 1000) / self.fps * 1000) if t >= 0 else 0

    def rows(self, t: int, seq: int, v: float) -> list[tuple[int, int, float]]:
        at, pos, out = self._snapped(t), min(100, max(0, round(v))), []
        if self.last is None:
            self.last = (at, seq, pos)
        elif at == self.last[0]:
            self.last = (at, seq, pos)
        elif at - self.last[0] >= self.gap:
            middle = (self.last[0], self.last[2])
            if self.before is None or not redundant(self.before, middle, (at, pos), self.tolerance):
                out, self.before = [(self.last[0], self.last[1], float(self.last[2]))], middle
            self.last = (at, seq, pos)
        return out

    def rest(self) -> list[tuple[int, int, float]]:
        return [] if self.last is None else [(self.last[0], self.last[1], float(self.last[2]))]


class QuietRuns:
    """Runs of moves under ``min_move`` that last ``min_ms`` or longer: a row at the start of each with its length in ms.

    Only the run that is still open is kept; a larger move closes it.
    """

    def __init__(self, min_move: float = 5, min_ms: float = 5000) -> None:
        self.min_move, self.min_ms = min_move, min_ms
        self.last: tuple[int, int, float] | None = None
        self.start: tuple[int, int] | None = None

    def rows(self, t: int, seq: int, v: float) -> list[tuple[int, int, float]]:
        out = []
        if self.last is not None:
            if abs(v - self.last[2]) < self.min_move:
                self.start = self.start or self.last[:2]
            else:
                out = self.rest()
        self.last = (t, seq, v)
        return out

    def rest(self) -> list[tuple[int, int, float]]:
        start, self.start = self.start, None
        long = start is not None and self.last[0] - start[0] >= self.min_ms
        return [(*start, float(self.last[0] - start[0]))] if long else []


class Beats:
    """Trigger on a z-score over the last ``window`` values; armed again once it falls to ``rearm`` of the threshold.

    Gives ``high`` and ``low`` by turns.
    """

    def __init__(self, sigma: float = 2.0, rearm: float = 0.6, gap: float = 250, window: int = 60, low: float = 10, high: float = 90) -> None:
        self.sigma, self.rearm, self.gap, self.low, self.high = sigma, rearm, gap, low, high
        self.values: deque = deque(maxlen=window)
        self.armed, self.last, self.up = True, None, True

    def feed(self, t: float, v: float) -> float | None:
        self.values.append(v)
        z = (v - float(np.mean(self.values))) / (float(np.std(self.values)) + 1e-6)
        hit = self.armed and z >= self.sigma and (self.last is None or t - self.last >= self.gap)
        if hit:
            self.armed, self.last = False, t
        if not self.armed and z <= self.sigma * self.rearm:
            self.armed = True
        if not hit:
            return None
        self.up = not self.up
        return self.low if self.up else self.high


class Metronome:
    """Ticks of ``bpm`` beats in ``subdivision`` parts, every other one late by ``swing`` per cent, from ``phase`` degrees on.

    Gives ``high`` and ``low`` by turns at the first value after a tick.
    """

    def __init__(self, bpm: float = 120, subdivision: int = 1, swing: float = 0, phase: float = 0, low: float = 10, high: float = 90) -> None:
        self.step, self.swing, self.phase, self.low, self.high = 60000.0 / bpm / subdivision, min(50.0, max(0.0, swing)) / 100, phase, low, high
        self.next, self.long, self.up = None, True, True

    def feed(self, t: float, v: float) -> float | None:
        if self.next is None:
            self.next = t + max(0.0, self.phase / 360 * self.step)
        hit = t >= self.next
        while t >= self.next:
            self.next += self.step * (1 + (self.swing if self.long else -self.swing))
            self.long = not self.long
        if not hit:
            return None
        self.up = not self.up
        return self.low if self.up else self.high


class Amplify:
    """Stretch by the 10th and 90th order statistics of the last ``window`` values, then smooth."""

    def __init__(self, window: int = 40, plateau: float = 5, alpha: float = 0.3) -> None:
        self.window, self.plateau, self.alpha = window, plateau, alpha
        self.values: deque = deque(maxlen=window)
        self.last = 50.0

    def feed(self, t: float, v: float) -> float:
        self.values.append(v)
        n, out = len(self.values), v
        if n >= self.window / 2:
            h = sorted(self.values)
            low, high = (h[int(n * 0.1)], h[min(n - 1, int(n * 0.9))]) if n >= 10 else (h[0], h[-1])
            if high - low > self.plateau:
                out = min(100.0, max(0.0, (v - low) / (high - low) * 100))
        self.last = self.alpha * out + (1 - self.alpha) * self.last
        return float(int(self.last))


class FlowPosition:
    """Signed flow to a position: median of seven, slow baseline, running percentiles, soft limit, smoothing."""

    def __init__(self, deadzone: float = 0.05, baseline: float = 0.02, window: int = 120, half: float = 40, soft: float = 48, sharp: float = 1.0, alpha: float = 0.35, drift: float = 0.015) -> None:
        self.deadzone, self.a, self.half, self.soft, self.sharp, self.alpha, self.drift = deadzone, baseline, half, soft, sharp, alpha, drift
        self.raw: deque = deque(maxlen=7)
        self.history: deque = deque(maxlen=window)
        self.base, self.range, self.centre, self.out = 0.0, 1.0, 0.0, 50.0

    def feed(self, t: float, v: float) -> float:
        self.raw.append(0.0 if abs(v) < self.deadzone else -v)
        median = sorted(self.raw)[len(self.raw) // 2]
        self.base += self.a * (median - self.base)
        signal = median - self.base
        self.history.append(signal)
        if len(self.history) > 20:
            p10, p50, p90 = np.percentile(self.history, (10, 50, 90))
            self.range += self.drift * (max(p90 - p10, 0.1) - self.range)
            self.centre += self.drift * (p50 - self.centre)
            level = (signal - self.centre) / max(self.range / 2, 0.05) * self.half
        else:
            level = signal * 200
        limited = 50 + self.soft * math.tanh(level / self.soft * self.sharp)
        self.out += self.alpha * (limited - self.out)
        return self.out


class Ema:
    """Exponential moving average that starts at the first value."""

    def __init__(self, alpha: float = 0.3) -> None:
        self.alpha, self.last = alpha, None

    def feed(self, t: float, v: float) -> float:
        self.last = v if self.last is None else self.alpha * v + (1 - self.alpha) * self.last
        return self.last


class EmaMedian:
    """Truncated moving average that is fed back through the median of the last ``window`` of its results."""

    def __init__(self, alpha: float = 0.6, window: int = 3) -> None:
        self.alpha, self.last = alpha, None
        self.results: deque = deque(maxlen=window)

    def feed(self, t: float, v: float) -> float:
        if self.last is None:
            self.last = v
            return float(v)
        self.results.append(int(self.alpha * v + (1 - self.alpha) * self.last))
        full = len(self.results) == self.results.maxlen
        self.last = int(np.median(self.results)) if full else self.results[-1]
        return float(self.last)


class AdaptiveScale:
    """Value between decaying extremes, mapped to 50 plus or minus ``deviation``, truncated."""

    def __init__(self, deviation: float = 40, window: int = 5, decay: float = 0.995) -> None:
        self.deviation, self.decay, self.low, self.high = deviation, decay, -0.2, 0.2
        self.recent: deque = deque(maxlen=window)

    def feed(self, t: float, v: float) -> float:
        self.recent.append(v)
        v = float(np.median(self.recent))
        self.low = min(self.low * self.decay, v * 0.9 if v < -0.1 else v * 1.1)
        self.high = max(self.high * self.decay, v * 1.1 if v > 0.1 else v * 0.9)
        low, high = min(self.low, -0.2), max(self.high, 0.2)
        part = min(1.0, max(-1.0, 2 * (v - low) / (high - low) - 1))
        return float(int(min(100, max(0, 50 + part * self.deviation))))


class Lock:
    """1 once the anchor was seen ``fps / 5`` frames running, 0 after it was missed for over ``2 fps``; v is 1 for seen."""

    def __init__(self, fps: float = 30) -> None:
        self.need, self.most, self.seen, self.missed, self.on = max(1, int(fps / 5)), 2 * fps, 0, 0, False

    def feed(self, t: float, v: float) -> float:
        self.seen, self.missed = (self.seen + 1, 0) if v > 0 else (0, self.missed + 1)
        self.on = self.seen >= self.need or (self.on and self.missed <= self.most)
        return float(self.on)


STEPS = {
    "rate_limit": RateLimit, "ingest": Ingest, "quiet_runs": QuietRuns, "beats": Beats, "metronome": Metronome, "amplify": Amplify, "flow_position": FlowPosition, "ema": Ema,
    "ema_median": EmaMedian, "adaptive_scale": AdaptiveScale, "lock": Lock,
}


def rows_of(step: object, t: int, seq: int, v: float) -> list[tuple[int, int, float]]:
    """Output rows ``(t, seq, out)`` that a value settles."""
    if hasattr(step, "rows"):
        return step.rows(t, seq, v)
    out = step.feed(t, v)
    return [] if out is None else [(t, seq, out)]


def rest_of(step: object) -> list[tuple[int, int, float]]:
    """Output rows that the end of the series settles."""
    return step.rest() if hasattr(step, "rest") else []
