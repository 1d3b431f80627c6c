"""Queries of the streaming jobs over ``events`` as a stream of files, and their batch twins."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetra.plans.base import query, table
from kinetra.streaming import jobs

TS = "CAST(ts AS TIMESTAMP)"


def _shared(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, or a temporary one where it is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _rows(events: DataFrame) -> DataFrame:
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)")
    return events.select(
        F.col("user_id").alias("series_id"), F.floor(micros / 36000000).cast("long").alias("t"), F.col("event_id").alias("seq"), F.col("value").alias("v"),
        F.col("ts").cast("timestamp").alias("ts"), "event_type",
    )


def live(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as a stream, a file in each micro-batch."""
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a pattern is read whether the table is one file or a folder of files
    return _rows(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path[:-1]}[t]"))


def lateness(spark: SparkSession, sf: str) -> int:
    """Milliseconds by which a row can be late: how far the files, which are read by the time they were written, reach back behind earlier ones.

    Files written at the same time are read in any order, so each counts as after all others of that time. Rows of one file are never late.
    """
    rows = spark.read.parquet(f"{sf}/events.parquet")
    files = rows.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("written"))
    files = files.agg(F.unix_millis(F.min("ts").cast("timestamp")).alias("low"), F.unix_millis(F.max("ts").cast("timestamp")).alias("high"))
    # a row for each time of writing: the highest time before it and, of its own files, the two highest
    times = files.groupBy("written").agg(F.slice(F.sort_array(F.collect_list("high"), False), 1, 2).alias("top"))
    times = times.withColumn("before", F.max(F.col("top")[0]).over(Window.orderBy("written").rowsBetween(Window.unboundedPreceding, -1)))
    other = F.when(F.size("top") > 1, F.when(F.col("high") == F.col("top")[0], F.try_element_at("top", F.lit(2))).otherwise(F.col("top")[0]))
    late = files.join(times, "written").agg(F.max(F.greatest(F.col("before"), other) - F.col("low"))).first()[0]
    return max(late or 0, 0) + 1_000


def closed(spark: SparkSession, sf: str, late_ms: int, base: str, past_ms: int = 0) -> tuple[DataFrame, Callable[[], None]]:
    """The live rows and a call that ends them: a row without a series, so late that the watermark passes all others by ``past_ms``."""
    rows, ending = live(spark, sf), f"{base}/ending"
    last = _rows(table(spark, sf, "events")).agg(F.max("ts").alias("ts"))
    mark = last.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name != "ts" else F.timestamp_millis(F.unix_millis("ts") + late_ms + past_ms + 1_000).alias("ts") for f in rows.schema])
    mark.limit(0).write.parquet(ending)
    ends = spark.readStream.schema(rows.schema).parquet(ending)
    return rows.unionByName(ends), lambda: mark.where("ts IS NOT NULL").write.mode("append").parquet(ending)


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that lists and timers need, while a stream is started; the session's own setting comes back."""
    key, provider = jobs.STATE_STORE
    own = spark.conf.get(key, None)
    spark.conf.set(key, provider)
    try:
        yield
    finally:
        spark.conf.unset(key) if own is None else spark.conf.set(key, own)


def finished(spark: SparkSession, out: DataFrame, mode: str, key: list[str], base: str | None = None, end: Callable[[], None] | None = None) -> DataFrame:
    """Run the stream to its end; of each key the row of the last micro-batch that changed it.

    ``end`` adds what follows the last file; the stream then goes on from its checkpoint.
    """
    base = base or _shared(spark)
    jobs.run_to_table(out, f"{base}/out", mode, f"{base}/state")
    if end is not None:
        end()
        jobs.run_to_table(out, f"{base}/out", mode, f"{base}/state")
    rows = spark.read.schema(T.StructType([*out.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{base}/out")
    cols = [c for c in out.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*cols), "batch").alias("r")).select(*key, "r.*")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def stream_rate(spark: SparkSession, sf: str) -> DataFrame:
    out = finished(spark, jobs.rate(live(spark, sf), f"{lateness(spark, sf)} milliseconds"), "update", ["start"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 6).alias("mean"))


@query(
    """SELECT user_id AS series_id, s AS start, count(*) AS n, round(avg(value), 6) AS mae FROM (
  SELECT *, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY ALL"""
)
def stream_problem_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = finished(spark, jobs.sliding_error(live(spark, sf), f"{lateness(spark, sf)} milliseconds"), "update", ["series_id", "start"])
    return out.select("series_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("mae", 6).alias("mae"))


@query(
    """SELECT user_id AS series_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN b IS NULL OR ts - b >= INTERVAL 8 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)) GROUP BY user_id, s"""
)
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """A session comes out once the watermark has passed it, so a last row ends the stream."""
    base, late = _shared(spark), lateness(spark, sf)
    rows, end = closed(spark, sf, late, base, 8 * 3_600_000)
    out = finished(spark, jobs.sessions(rows, f"{late} milliseconds"), "append", ["series_id", "start"], base, end)
    return out.where("series_id IS NOT NULL").select("series_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT DISTINCT user_id || '/' || event_type AS path FROM events")
def stream_new_files(spark: SparkSession, sf: str) -> DataFrame:
    files = live(spark, sf).select(F.concat_ws("/", F.col("series_id").cast("string"), "event_type").alias("path"), "ts")
    out = jobs.new_files(files, "60 days")
    return finished(spark, out.select("path", F.lit(1).alias("one")), "append", ["path"]).select("path")


T_SQL = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 36000000"
#: The values of each series in order, and a step from row to row by recursion: first state, next state, what comes out.
E_SQL = f"""e AS (SELECT user_id AS series_id, {T_SQL} AS t, event_id AS seq, value::DOUBLE AS v,
  row_number() OVER (PARTITION BY user_id ORDER BY {T_SQL}, event_id) AS i FROM events)"""


def _recursive(first: str, following: str, out: str, where: str = "true", rows: str = E_SQL) -> str:
    return f"""WITH RECURSIVE {rows}, s AS (SELECT e.*, {first} FROM e WHERE i = 1
  UNION ALL SELECT e.*, {following} FROM s JOIN e ON e.series_id = s.series_id AND e.i = s.i + 1)
SELECT series_id, t, seq, round(({out})::DOUBLE, 6) AS out FROM s WHERE {where}"""


def _spaced(gap: int) -> tuple[str, str]:
    return "e.t AS last, true AS hit", f"CASE WHEN e.t - s.last >= {gap} THEN e.t ELSE s.last END, e.t - s.last >= {gap}"


#: The rows in which a condition last held, against each other: no state is carried.
LOCK_SQL = f"""WITH {E_SQL}, a AS (SELECT *, i - coalesce(max(CASE WHEN v - 60 <= 0 THEN i END) OVER w, 0) AS seen, i - coalesce(max(CASE WHEN v - 60 > 0 THEN i END) OVER w, 0) AS missed
  FROM e WINDOW w AS (PARTITION BY series_id ORDER BY i))
SELECT series_id, t, seq, CASE WHEN max(CASE WHEN seen >= 2 THEN i END) OVER w > coalesce(max(CASE WHEN missed > 20 THEN i END) OVER w, 0) THEN 1.0::DOUBLE ELSE 0.0 END AS out
FROM a WINDOW w AS (PARTITION BY series_id ORDER BY i)"""
SCALE_SQL = _recursive(
    "least(-0.2 * 0.995::DOUBLE, CASE WHEN m < -0.1 THEN m * 0.9 ELSE m * 1.1 END) AS lo, greatest(0.2 * 0.995::DOUBLE, CASE WHEN m > 0.1 THEN m * 1.1 ELSE m * 0.9 END) AS hi",
    "least(s.lo * 0.995, CASE WHEN e.m < -0.1 THEN e.m * 0.9 ELSE e.m * 1.1 END), greatest(s.hi * 0.995, CASE WHEN e.m > 0.1 THEN e.m * 1.1 ELSE e.m * 0.9 END)",
    "trunc(least(100, greatest(0, 50 + least(1, greatest(-1, 2 * (m - least(lo, -0.2)) / (greatest(hi, 0.2) - least(lo, -0.2)) - 1)) * 40)))",
    rows=E_SQL.replace("e AS (", "f AS (")
    + ", e AS (SELECT *, quantile_cont(v - 50, 0.5) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM f)",
)
MEDIAN_SQL = _recursive(
    "v AS last, NULL::DOUBLE AS p1, NULL::DOUBLE AS p2",
    """CASE WHEN s.p2 IS NULL THEN trunc(0.6 * e.v + (1 - 0.6::DOUBLE) * s.last) ELSE list_sort([trunc(0.6 * e.v + (1 - 0.6::DOUBLE) * s.last), s.p1, s.p2])[2] END,
  trunc(0.6 * e.v + (1 - 0.6::DOUBLE) * s.last), s.p1""",
    "last",
)
#: Ingest: times with their first and last point, spacing by recursion, then the last three points by recursion: a point comes as its time's first.
INGEST_SQL = f"""WITH RECURSIVE {E_SQL}, q AS (
  SELECT series_id, t, seq, CAST(least(100, greatest(0, round_even(v, 0))) AS BIGINT) AS pos, CAST(round_even(round_even(t * 0.5 / 1000, 0) / 0.5 * 1000, 0) AS BIGINT) AS tt FROM e
), g AS (
  SELECT series_id, tt, arg_max(seq, (t, seq)) AS seq, arg_max(pos, (t, seq)) AS pos, arg_min(pos, (t, seq)) AS came, row_number() OVER (PARTITION BY series_id ORDER BY tt) AS k FROM q GROUP BY series_id, tt
), sp AS (
  SELECT series_id, tt, seq, pos, came, k, tt AS kept FROM g WHERE k = 1
  UNION ALL SELECT g.series_id, g.tt, g.seq, g.pos, g.came, g.k, CASE WHEN g.tt - sp.kept >= 3000 THEN g.tt ELSE sp.kept END FROM sp JOIN g ON g.series_id = sp.series_id AND g.k = sp.k + 1
), p AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY tt) AS j FROM sp WHERE tt = kept
), s AS (
  SELECT series_id, j, tt, seq, pos, NULL::BIGINT AS a0, NULL::BIGINT AS p0, NULL::BIGINT AS oa, NULL::BIGINT AS os, NULL::BIGINT AS op FROM p WHERE j = 1
  UNION ALL SELECT p.series_id, p.j, p.tt, p.seq, p.pos,
    CASE WHEN d THEN s.a0 ELSE s.tt END, CASE WHEN d THEN s.p0 ELSE s.pos END, CASE WHEN d THEN NULL ELSE s.tt END, CASE WHEN d THEN NULL ELSE s.seq END, CASE WHEN d THEN NULL ELSE s.pos END
  FROM (SELECT s.*, p.tt AS na, coalesce((s.pos - s.p0) * (s.pos - p.came) <= 0 AND
      abs((s.tt - s.a0) * (p.came - s.p0) - (p.tt - s.a0) * (s.pos - s.p0)) <= 2 * (p.tt - s.a0), false) AS d FROM s JOIN p ON p.series_id = s.series_id AND p.j = s.j + 1) s
  JOIN p ON p.series_id = s.series_id AND p.j = s.j + 1
)
SELECT series_id, oa AS t, os AS seq, op::DOUBLE AS out FROM s WHERE oa IS NOT NULL
UNION ALL SELECT series_id, tt, seq, pos::DOUBLE FROM s QUALIFY j = max(j) OVER (PARTITION BY series_id)"""
#: Runs of small moves as islands of rows.
QUIET_SQL = f"""WITH {E_SQL}, m AS (
  SELECT *, abs(lead(v) OVER w - v) < 40 AS small, lead(t) OVER w AS until FROM e WINDOW w AS (PARTITION BY series_id ORDER BY i)
), r AS (
  SELECT *, sum(CASE WHEN small THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY i) AS run FROM m WHERE until IS NOT NULL
)
SELECT series_id, min(t) AS t, arg_min(seq, i) AS seq, (max(until) - min(t))::DOUBLE AS out FROM r WHERE small GROUP BY series_id, run HAVING max(until) - min(t) >= 3000"""
STEP_SQL = {
    "ingest": INGEST_SQL,
    "quiet_runs": QUIET_SQL,
    "rate_limit": _recursive(*_spaced(500), "least(100, greatest(0, round_even(v, 0)))", "hit"),
    "pose_ema": _recursive("v AS last", "0.3::DOUBLE * e.v + (1 - 0.3::DOUBLE) * s.last", "last"),
}
#: Time without rows after which a series ends; the tables span less, so none ends before its time.
IDLE_MS = 400 * 86_400_000
#: Series that share a key of the state.
SERIES_TOGETHER = 64


def _twin(name: str, step: str, **params: float) -> None:
    @query(STEP_SQL.get(name), name=f"batch_{name}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return jobs.batch(_rows(table(spark, sf, "events")), step, **params).withColumn("out", F.round("out", 6))

    @query(STEP_SQL.get(name), name=f"stream_{name}")
    def live_run(spark: SparkSession, sf: str) -> DataFrame:
        """All rows: none is later than allowed, and the watermark passes them, and what ends a series, at the end of the input."""
        base, late = _shared(spark), lateness(spark, sf)
        rows, end = closed(spark, sf, late, base, IDLE_MS)
        with state_store(spark):
            out = jobs.stream(rows, step, late, IDLE_MS, SERIES_TOGETHER, **params)
            return finished(spark, out, "append", ["series_id", "t", "seq"], base, end).withColumn("out", F.round("out", 6))


for _name, _step, _params in (
    ("ingest", "ingest", {"gap": 3000, "fps": 0.5}),
    ("quiet_runs", "quiet_runs", {"min_move": 40, "min_ms": 3000}),
    ("rate_limit", "rate_limit", {"per_second": 2}),
    ("beats", "beats", {"sigma": 1.5}),
    ("amplify", "amplify", {}),
    ("flow_position", "flow_position", {}),
    ("pose_ema", "ema", {}),
    ("metronome", "metronome", {"bpm": 40, "swing": 20}),
):
    _twin(_name, _step, **_params)


def _batch_only(name: str, step: str, shift: float = 0.0, sql: str | None = None, **params: float) -> None:
    @query(sql, name=name)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = _rows(table(spark, sf, "events")).withColumn("v", F.col("v") - shift)
        return jobs.batch(rows, step, **params).withColumn("out", F.round("out", 6))


_batch_only("adaptive_scale", "adaptive_scale", 50, SCALE_SQL)
_batch_only("ema_median_smooth", "ema_median", sql=MEDIAN_SQL)
_batch_only("metronome", "metronome", bpm=40, swing=20)
_batch_only("lock_state", "lock", 60, LOCK_SQL, fps=10)
