"""Queries of the compound operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.operators import beats as B
from kinetra.operators import comparison as Z
from kinetra.operators import compound as C
from kinetra.operators import editing as E
from kinetra.plans.base import on_points, points, query
from kinetra.plans.q_editing import FRAMES, RUNS, frame_chapters, frames, on_fc
from kinetra.plans.q_joins import boxes, chapters, samples
from kinetra.plans.q_tracks import tracks
from kinetra.plans.registry import PRESETS, run_pipeline

S = "(PARTITION BY series_id, axis ORDER BY at, seq)"


@query()
def ultimate_autotune(spark: SparkSession, sf: str) -> DataFrame:
    return C.ultimate_autotune(points(spark, sf))


@query()
def savgol_autotune(spark: SparkSession, sf: str) -> DataFrame:
    return C.savgol_autotune(points(spark, sf), 9, 2)


@query()
def comparison_peaks(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return Z.peak_classes(Z.classified_peaks(p.where("seq % 2 = 0"), p.where("seq % 2 = 1"), window=2000))


@query()
def chapter_peaks(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return Z.peaks_by_chapter(Z.classified_peaks(p.where("seq % 2 = 0"), p.where("seq % 2 = 1"), window=2000), chapters(spark, sf))


@query()
def match_peaks(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return C.match_peaks(p.where("seq % 2 = 0"), p.where("seq % 2 = 1"), 2000)


@query()
def overlay_match(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of one class in stored frames one after the other."""
    b = boxes(spark, sf)
    b = b.withColumn("box_id", F.xxhash64("box_id", "x1", "y1", "frame_id")).withColumn("frame_id", F.floor(F.col("frame_id") / 100).cast("long"))
    return C.overlay_match(C.overlay_pairs(b))


@query(
    on_fc("""SELECT series_id, chapter_id, start_frame, end_frame FROM fc WHERE label <> 'idle'
UNION ALL SELECT series_id, chapter_id, start_frame, end_frame FROM fc n WHERE label = 'idle'
  AND NOT EXISTS (SELECT 1 FROM fc o WHERE o.label <> 'idle' AND o.series_id = n.series_id AND greatest(o.start_frame, n.start_frame) <= least(o.end_frame, n.end_frame))""")
)
def chapters_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Idle chapters lie apart, so only those that meet another chapter are left out."""
    c = frame_chapters(spark, sf)
    return C.chapters_merge(c.where("label <> 'idle'"), c.where("label = 'idle'"))


@query()
def segments_stabilise(spark: SparkSession, sf: str) -> DataFrame:
    return C.segments_stabilise(E.label_runs(frames(spark, sf)), 0.5, "view", ("click", "signup"), "click", ("purchase",))


@query(f"WITH {FRAMES}, {RUNS} SELECT series_id, min(start_frame) AS first_frame, max(end_frame) AS last_frame FROM runs GROUP BY 1")
def segments_extent(spark: SparkSession, sf: str) -> DataFrame:
    """Stabilised segments cover the same frames as the runs, without gaps (their number is checked in tests)."""
    out = C.segments_stabilise(E.label_runs(frames(spark, sf)), 0.5, "view")
    return out.groupBy("series_id").agg(F.min(F.greatest("start_frame", F.lit(1))).alias("first_frame"), F.max("end_frame").alias("last_frame"))


@query()
def savgol_unsaturated(spark: SparkSession, sf: str) -> DataFrame:
    return C.savgol_unsaturated(points(spark, sf))


@query()
def smooth_tracks(spark: SparkSession, sf: str) -> DataFrame:
    out = C.smooth_tracks(tracks(spark, sf))
    return out.withColumns({c: F.round(c, 4) for c in ("x1", "y1", "x2", "y2")})


@query()
def flow_to_position(spark: SparkSession, sf: str) -> DataFrame:
    return C.flow_to_position(samples(spark, sf).select("series_id", F.col("i").cast("long").alias("frame_id"), F.col("value").alias("dy")), 10)


@query(
    """WITH r AS (SELECT series_id, i // 4 AS h, sqrt(avg(v * v)) AS e FROM (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value - 50 AS v FROM events) GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY h) AS n, count(*) OVER (PARTITION BY series_id) AS c FROM r),
k AS (SELECT series_id, n.h, n.c, unnest([CASE WHEN n - 2 < 1 THEN 1 - (n - 2) WHEN n - 2 > c THEN 2 * c + 1 - (n - 2) ELSE n - 2 END, CASE WHEN n - 1 < 1 THEN 1 - (n - 1) ELSE n - 1 END, n, CASE WHEN n + 1 > c THEN 2 * c + 1 - (n + 1) ELSE n + 1 END,
  CASE WHEN n + 2 > c THEN 2 * c + 1 - (n + 2) ELSE n + 2 END]) AS m FROM n),
s AS (SELECT k.series_id, k.h, sum(n.e) / 5 AS s FROM k JOIN n ON n.series_id = k.series_id AND n.n = k.m GROUP BY ALL)
SELECT series_id, h AS hop, round(CASE WHEN p > 0 THEN least(1, s / p) ELSE 0 END, 6) AS energy FROM (SELECT *, quantile_cont(s, 0.99) OVER (PARTITION BY series_id) AS p FROM s)"""
)
def energy_envelope(spark: SparkSession, sf: str) -> DataFrame:
    return C.energy_envelope(samples(spark, sf), 4, 5).withColumn("energy", F.round("energy", 6))


@query()
def beats_to_points(spark: SparkSession, sf: str) -> DataFrame:
    """Beats and sound of the points: a position is the energy of its second."""
    p = points(spark, sf)
    sound = p.groupBy("series_id", F.floor(F.col("at") / 1000).alias("hop")).agg((F.max("pos") / 100).alias("energy"))
    return B.beats_to_points(p.select("series_id", (F.col("at") / 1000).alias("t")), sound, 1.0)


@query(on_points("""SELECT series_id, CAST(k AS INTEGER) AS k, k * (60000.0::DOUBLE / 90 / 2) AS t, CASE WHEN k % 8 = 0 THEN 'downbeat' WHEN k % 2 = 0 THEN 'quarter' ELSE 'sub' END AS level
FROM (SELECT series_id, unnest(range(0, 61)) AS k FROM (SELECT DISTINCT series_id FROM points))"""))
def beat_lines(spark: SparkSession, sf: str) -> DataFrame:
    return C.beat_lines(points(spark, sf).select("series_id").distinct(), 90, 2, 20000)


@query(
    on_points(f"""SELECT series_id, axis, at, pos, seq, CAST(session AS BIGINT) AS session, round(60000 / nullif(avg(CASE WHEN nw = 0 THEN g END) OVER (PARTITION BY series_id, axis, session ORDER BY at, seq ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0), 6) AS bpm
FROM (SELECT *, sum(nw) OVER {S} AS session FROM (SELECT *, CASE WHEN g IS NULL OR g > 1500 THEN 1 ELSE 0 END AS nw FROM (SELECT *, at - lag(at) OVER {S} AS g FROM points)))""")
)
def tap_tempo(spark: SparkSession, sf: str) -> DataFrame:
    return C.tap_tempo(points(spark, sf), 1500, 8).withColumn("bpm", F.round("bpm", 6))


def _sines() -> str:
    rows = ", ".join(f"('{a}', {f!r}::DOUBLE, {p!r}::DOUBLE, {m})" for a, f, p, m in C.SINES)
    return on_points(f"""SELECT series_id, axis, CAST(t AS BIGINT) AS at, CAST(least(100, greatest(0, round_even(round(50 + m * sin(2 * pi() * f * t / 1000::DOUBLE + p), 6), 0))) AS INTEGER) AS pos
FROM (SELECT DISTINCT series_id FROM points), (VALUES {rows}) w(axis, f, p, m), (SELECT unnest(range(0, 5001, 100)) AS t)""")


@query(_sines())
def generate_sines(spark: SparkSession, sf: str) -> DataFrame:
    return C.generate_sines(points(spark, sf).select("series_id").distinct(), 5000)


@query()
def preset_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """The preset for devices; one shuffle by series serves all its steps."""
    out, errors = run_pipeline(points(spark, sf, None), PRESETS["device"])
    if errors:
        raise ValueError("; ".join(errors))
    return out
