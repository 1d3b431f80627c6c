"""Structured Streaming jobs of the live operators, and their batch twins.

Stateful jobs keep one small step for each series and, in a list state, the rows that the watermark has not passed yet: a row
that comes late, but within the watermark, takes its place among them. New rows are appended to the list, which is not read for
that. An event-time timer of the earliest row feeds those that are due in time order and keeps the rest. Rows later than
the watermark allows are dropped by Spark. A block of neighbouring series can share one key, so that the calls to the state store,
which cost more than the steps, are as many as the blocks; a block's size is bounded, however many series there are.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from kinetra.operators.groups import grouped
from kinetra.streaming.steps import STEPS, rest_of, rows_of

OUT = "series_id long, t long, seq long, out double"


def batch(rows: DataFrame, step: str, **params: float) -> DataFrame:
    """``(series_id, t, seq, out)`` of ``rows(series_id, t, seq, v)``: the step on each series in time order."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["t", "seq"], kind="stable")
        state, out = STEPS[step](**params), []
        for t, seq, v in zip(group["t"].tolist(), group["seq"].tolist(), group["v"].tolist(), strict=True):
            out += rows_of(state, t, seq, v)
        series = group["series_id"].iloc[0] if len(group) else None
        return _table([(series, *r) for r in out + rest_of(state)])

    return grouped(rows.select("series_id", "t", "seq", F.col("v").cast("double").alias("v")), ("series_id",), run, OUT)


def _table(rows: list[tuple[int, int, int, float]]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["series_id", "t", "seq", "out"])
    return out.astype({"series_id": "int64", "t": "int64", "seq": "int64", "out": "float64"})


class _Live(StatefulProcessor):
    """A step on each series of a block, fed in event-time order."""

    def __init__(self, step: str, params: dict[str, float], idle_ms: int) -> None:
        self.fresh, self.idle_ms = (step, params), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "own long, ts long, t long, seq long, v double")
        self.steps = handle.getListState("steps", "own long, step binary, last long")

    def _wake(self, at: int) -> None:
        """One timer, at ``at`` or where it stands earlier."""
        timers = list(self.handle.listTimers())
        if not timers or min(timers) > at:
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            # a filter before the watermark would keep it from seeing all rows
            part = part.dropna() if key[0] is not None else part[:0]
            if not len(part):
                continue
            ts = (part["ts"].astype("int64") // 1_000_000).tolist()
            own, t, seq = (part[c].astype("int64").tolist() for c in ("own", "t", "seq"))
            self.waiting.appendList(list(zip(own, ts, t, seq, part["v"].tolist(), strict=True)))
            first = min(ts) if first is None else min(first, *ts)
        if first is not None:
            self._wake(first)
        yield _table([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        rest, due = [r for r in rows if r[1] > passed], {}
        for own, ts, t, seq, v in sorted((r for r in rows if r[1] <= passed), key=lambda r: (r[0], r[2], r[3])):
            due.setdefault(own, []).append((ts, t, seq, v))
        steps = {own: (step, last) for own, step, last in self.steps.get()} if self.steps.exists() else {}
        more, kept, out = {r[0] for r in rest}, [], []
        name, params = self.fresh
        for own in sorted({*due, *steps}):
            stored, last = steps.get(own, (None, -1))
            ends = own not in more and passed >= max([last, *(r[0] for r in due.get(own, ()))]) + self.idle_ms
            if own not in due and not ends:
                kept.append((own, stored, last))
                continue
            step = STEPS[name](**params) if stored is None else pickle.loads(stored)  # noqa: S301
            for ts, t, seq, v in due.get(own, ()):
                out += [(own, *r) for r in rows_of(step, t, seq, v)]
                last = max(last, ts)
            if ends:
                out += [(own, *r) for r in rest_of(step)]
            else:
                kept.append((own, pickle.dumps(step), last))
        for state, values in ((self.waiting, rest), (self.steps, kept)):
            state.put(values) if values else state.clear()
        at = [r[1] for r in rest] + [last + self.idle_ms for own, _, last in kept if own not in more]
        if at:
            self.handle.registerTimer(min(at))
        yield _table(out)

    def close(self) -> None:
        pass


def stream(rows: DataFrame, step: str, late_ms: int = 60_000, idle_ms: int = 86_400_000, together: int = 1, **params: float) -> DataFrame:
    """The same on a stream ``rows(series_id, t, seq, v, ts)`` with event time ``ts``, late rows of up to ``late_ms``.

    The state of a series goes once the watermark is ``idle_ms`` past its last row, with what that settles; what comes later starts
    anew. Rows without a series, time or place are no points. Series whose ids lie in the same ``together`` numbers share a key, the first
    of these; a running stream keeps the number it was started with. The session needs ``STATE_STORE``.
    """
    own = F.col("series_id").cast("long")
    timed = rows.withWatermark("ts", f"{late_ms} milliseconds")
    timed = timed.select((own - F.pmod(own, F.lit(together))).alias("series_id"), own.alias("own"), "t", "seq", F.col("v").cast("double").alias("v"), "ts")
    return timed.groupBy("series_id").transformWithStateInPandas(_Live(step, params, idle_ms), outputStructType=OUT, outputMode="append", timeMode="EventTime")


#: What keeps lists and timers: a setting of the session that runs such a stream.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def rate(rows: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Rows and mean value of each tumbling window."""
    w = F.window("ts", width)
    return rows.withWatermark("ts", late).groupBy(w).agg(F.count("*").alias("n"), F.avg("v").alias("mean")).select(F.col("window.start").alias("start"), "n", "mean")


def sliding_error(rows: DataFrame, late: str = "10 minutes", width: str = "12 hours", step: str = "6 hours") -> DataFrame:
    """Mean of ``v`` over sliding windows of each series."""
    w = F.window("ts", width, step)
    return rows.withWatermark("ts", late).groupBy("series_id", w).agg(F.count("*").alias("n"), F.avg("v").alias("mae")).select("series_id", F.col("window.start").alias("start"), "n", "mae")


def sessions(rows: DataFrame, late: str = "10 minutes", gap: str = "8 hours") -> DataFrame:
    """Sessions of each series: a pause of ``gap`` or more ends one."""
    w = F.session_window("ts", gap)
    return rows.withWatermark("ts", late).groupBy("series_id", w).agg(F.count("*").alias("n")).select("series_id", F.col("session_window.start").alias("start"), "n")


def new_files(files: DataFrame, late: str = "1 day") -> DataFrame:
    """Each path once (``path``, ``ts``); paths seen within the watermark are skipped."""
    return files.withWatermark("ts", late).dropDuplicatesWithinWatermark(["path"])


def rolling_filter(path: str, change: Callable[[DataFrame], DataFrame], window_ms: int) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: new points join the table at ``path`` and the last ``window_ms`` of each touched series
    are filtered again.

    Points that the window has left are written once, to a folder of the batch (``closed``). The windows of all series are
    written anew with each batch (``open``), which is bounded by their number. A repeated batch overwrites its own folders.
    """

    def run(new: DataFrame, batch_id: int) -> None:
        spark = new.sparkSession
        whole = Window.partitionBy("series_id", "axis")
        every = _last_open(spark, path, new, batch_id).withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        marked = every.withColumns({"_z": F.max("at").over(whole) - window_ms, "_new": F.max("_new").over(whole)}).persist()
        inside = F.col("at") >= F.col("_z")
        marked.where(~inside).select(new.columns).write.mode("overwrite").parquet(f"{path}/closed/batch={batch_id}")
        tail = change(marked.where(inside & (F.col("_new") == 1)).select(new.columns)).select(new.columns)
        still = marked.where(inside & (F.col("_new") == 0)).select(new.columns)
        tail.unionByName(still).write.mode("overwrite").parquet(f"{path}/open/batch={batch_id}")
        marked.unpersist()

    return run


def _batches(spark: SparkSession, path: str, like: DataFrame) -> DataFrame | None:
    try:
        return spark.read.schema(T.StructType([*like.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(path)
    except AnalysisException as e:  # no batch has been written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def _last_open(spark: SparkSession, path: str, like: DataFrame, before: int | None = None) -> DataFrame:
    """The windows of the highest batch (under ``before``)."""
    rows = _batches(spark, f"{path}/open", like)
    if rows is None:
        return spark.createDataFrame([], like.schema)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    top = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == (-1 if top is None else top)).select(like.columns)


def latest(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """All points of the table: those that are closed and the windows of the last batch."""
    done = _batches(spark, f"{path}/closed", like)
    now = _last_open(spark, path, like)
    return now if done is None else done.select(like.columns).unionByName(now)


def run_to_table(out: DataFrame, path: str, mode: str, checkpoint: str) -> None:
    """Run a stream over all there is and write each micro-batch to a folder of ``path``; a batch that is repeated overwrites its own."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
