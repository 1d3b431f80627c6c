"""Queries of the window operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.operators import windows as X
from kinetra.plans.base import on_points, points, query
from kinetra.plans.registry import Step, run_pipeline

S = "(PARTITION BY series_id, axis ORDER BY at, seq)"
G = "(PARTITION BY series_id, axis)"
C = "series_id, axis, at, pos, seq"


def _near(body: str, inner: str = "points") -> str:
    """``body`` over points with the neighbours' positions b and n."""
    return on_points(f"SELECT {body} FROM (SELECT *, lag(pos) OVER {S} AS b, lead(pos) OVER {S} AS n FROM {inner})")


SEGMENTS = f"""seg AS (
  SELECT series_id, axis, at AS start, e AS end_, pos AS from_pos, q AS to_pos, abs(q - pos) / greatest(e - at, 1)::DOUBLE * 1000 AS speed
  FROM (SELECT *, lead(at) OVER {S} AS e, lead(pos) OVER {S} AS q FROM points) WHERE e IS NOT NULL
)"""


@query(on_points("SELECT 1").replace("\nSELECT 1", f", {SEGMENTS}\nSELECT series_id, axis, start, end_ AS end, from_pos, to_pos, speed FROM seg"))
def segment_speeds(spark: SparkSession, sf: str) -> DataFrame:
    return X.segment_speeds(points(spark, sf))


@query(on_points("SELECT 1").replace("\nSELECT 1", f", {SEGMENTS}\nSELECT series_id, axis, start, end_ AS end, from_pos, to_pos, speed FROM seg WHERE speed > 400"))
def speed_violations(spark: SparkSession, sf: str) -> DataFrame:
    return X.speed_violations(points(spark, sf), 400)


@query(_near("series_id, axis, at, pos, seq, coalesce(pos > b AND pos > n, false) AS top, coalesce(pos < b AND pos < n, false) AS bottom"))
def extrema_strict(spark: SparkSession, sf: str) -> DataFrame:
    return X.strict_extrema(points(spark, sf))


_TOP = "CASE WHEN b IS NULL AND n IS NULL THEN false WHEN b IS NULL THEN pos {0} n WHEN n IS NULL THEN pos {0} b ELSE pos {0} b AND pos {0}= n END"


@query(_near(C) + f" WHERE ({_TOP.format('>')}) OR ({_TOP.format('<')})")
def extrema_select(spark: SparkSession, sf: str) -> DataFrame:
    return X.select_extrema(points(spark, sf), "both")


@query(_near(C) + f" WHERE {_TOP.format('>')}")
def extrema_select_top(spark: SparkSession, sf: str) -> DataFrame:
    return X.select_extrema(points(spark, sf), "top")


@query(
    on_points(f"""SELECT {C} FROM (SELECT *, lag(pos, 1, -1) OVER {S} AS b, lead(pos, 1, -1) OVER {S} AS n FROM points WHERE pos < 90)
WHERE NOT (pos > b AND pos >= n) AND NOT (pos < b AND pos <= n)""")
)
def selection_extrema_filter(spark: SparkSession, sf: str) -> DataFrame:
    return X.selection_extrema(points(spark, sf), "mid", F.col("pos") < 90)


@query(
    on_points(f"""SELECT {C} FROM (SELECT *, lag(pos) OVER {S} AS b, lead(pos) OVER {S} AS n, count(*) OVER {G} AS c FROM points)
WHERE c < 3 OR b IS NULL OR n IS NULL OR (pos - b > 2 AND n - pos < -2) OR (pos - b < -2 AND n - pos > 2)""")
)
def reversal_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return X.reversal_peaks(points(spark, sf))


ANCHORS = f"""r AS (
  SELECT *, row_number() OVER {S} AS i, sum(CASE WHEN p0 IS NULL OR pos <> p0 THEN 1 ELSE 0 END) OVER {S} AS run FROM (SELECT *, lag(pos) OVER {S} AS p0 FROM points)
), g AS (
  SELECT series_id, axis, run, min(i) AS f, max(i) AS l, any_value(pos) AS pos FROM r GROUP BY ALL
), h AS (
  SELECT *, lag(pos) OVER w AS b, lead(pos) OVER w AS n FROM g WINDOW w AS (PARTITION BY series_id, axis ORDER BY run)
), anchors AS (
  SELECT r.series_id, r.axis, r.at, r.pos, r.seq FROM (SELECT *, max(i) OVER {G} AS m FROM r) r JOIN h USING (series_id, axis, run)
  WHERE i = 1 OR i = m OR (((r.pos > b AND r.pos > n) OR (r.pos < b AND r.pos < n)) AND i = (f + l) // 2)
)"""


@query(on_points("SELECT 1").replace("\nSELECT 1", f", {ANCHORS}\nSELECT * FROM anchors"))
def plateau_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return X.plateau_anchors(points(spark, sf))


@query(
    on_points(f"""SELECT {C} FROM (SELECT *, lag(at) OVER {S} AS ta, lead(at) OVER {S} AS tz, lag(pos) OVER {S} AS pa, lead(pos) OVER {S} AS pz FROM points)
WHERE NOT coalesce((ta >= at OR abs(pos - pa) / (at - ta)::DOUBLE * 1000 > 300) AND (tz <= at OR abs(pz - pos) / (tz - at)::DOUBLE * 1000 > 300), false)""")
)
def remove_speed_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return X.drop_speed_artifacts(points(spark, sf), 300)


@query(
    on_points("""SELECT series_id, axis, at, CAST(CASE WHEN hi - lo >= 5 THEN least(100, greatest(0, round_even((pos - lo) / (hi - lo)::DOUBLE * 100, 0))) ELSE pos END AS INTEGER) AS pos, seq
FROM (SELECT *, min(pos) OVER w AS lo, max(pos) OVER w AS hi FROM points
      WINDOW w AS (PARTITION BY series_id, axis ORDER BY at RANGE BETWEEN 2000 PRECEDING AND 2000 FOLLOWING))""")
)
def dynamic_amplify(spark: SparkSession, sf: str) -> DataFrame:
    return X.dynamic_amplify(points(spark, sf))


def _savgol_sql(window: int, degree: int) -> str:
    w, h = X.savgol_weights(window, degree), window // 2
    rows = ", ".join("[" + ", ".join(f"{v!r}::DOUBLE" for v in r.tolist()) + "]" for r in w)
    return on_points(f"""SELECT p.series_id, p.axis, p.at, CAST(CASE WHEN c >= {window} THEN least(100, greatest(0, round_even(round(
    (SELECT sum(q.pos * ([{rows}])[CAST(p.i - p.f AS INTEGER) + 1][CAST(q.i - p.f AS INTEGER) + 1]) FROM x q WHERE q.series_id = p.series_id AND q.axis = p.axis AND q.i BETWEEN p.f AND p.f + {window - 1}), 9), 0)))
  ELSE p.pos END AS INTEGER) AS pos, p.seq
FROM (SELECT *, greatest(1, least(i - {h}, c - {window - 1})) AS f FROM x) p""").replace(
        "\nSELECT p.series_id", f", x AS (SELECT *, row_number() OVER {S} AS i, count(*) OVER {G} AS c FROM points)\nSELECT p.series_id"
    )


@query(_savgol_sql(7, 3))
def savgol_smooth(spark: SparkSession, sf: str) -> DataFrame:
    return X.savgol(points(spark, sf))


@query(
    on_points(f"""SELECT series_id, axis, at, CAST(CASE WHEN c >= 3 AND e > 0 THEN least(100, greatest(0, round_even(round(50 + 0.005::DOUBLE * 50 * (pos - m) / e * 100, 6), 0))) ELSE pos END AS INTEGER) AS pos, seq
FROM (SELECT *, sum(abs(pos - m)) OVER (PARTITION BY series_id, axis ORDER BY at, seq ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) / (k - 1) AS e
  FROM (SELECT *, (sum(pos) OVER w - (first(pos) OVER w + last(pos) OVER w) / 2.0::DOUBLE) / 6 AS m, count(*) OVER w AS k, count(*) OVER {G} AS c FROM points
        WINDOW w AS (PARTITION BY series_id, axis ORDER BY at, seq ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)))""")
)
def moving_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return X.moving_normalize(points(spark, sf))


@query(
    on_points(f"""SELECT series_id, axis, at, CAST(CASE WHEN c >= 4 AND t1 > t0 THEN least(100, greatest(0, round_even(round(
    50 * (pos - ((la + ha) / 2.0::DOUBLE + ((lz + hz) / 2.0::DOUBLE - (la + ha) / 2.0::DOUBLE) * f)) / greatest((ha - la) + ((hz - lz) - (ha - la)) * f, 1) + 50, 6), 0))) ELSE pos END AS INTEGER) AS pos, seq
FROM (SELECT *, (at - t0) / nullif(t1 - t0, 0)::DOUBLE AS f FROM (
  SELECT *, min(at) OVER g AS t0, max(at) OVER g AS t1, min(CASE WHEN i <= k + 1 THEN pos END) OVER g AS la, max(CASE WHEN i <= k + 1 THEN pos END) OVER g AS ha,
    min(CASE WHEN i >= c - k THEN pos END) OVER g AS lz, max(CASE WHEN i >= c - k THEN pos END) OVER g AS hz
  FROM (SELECT *, least(4, c // 2) AS k FROM (SELECT *, row_number() OVER {S} AS i, count(*) OVER {G} AS c FROM points)) WINDOW g AS {G}))""")
)
def detrend(spark: SparkSession, sf: str) -> DataFrame:
    return X.detrend(points(spark, sf))


@query(
    on_points(f"""SELECT series_id, axis, at, CASE WHEN pos > b AND pos > n THEN hi WHEN pos < b AND pos < n THEN lo ELSE pos END AS pos, seq
FROM (SELECT *, lag(pos) OVER {S} AS b, lead(pos) OVER {S} AS n, min(pos) OVER {G} AS lo, max(pos) OVER {G} AS hi FROM points)""")
)
def align_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return X.align_peaks(points(spark, sf))


@query(
    on_points(f"""SELECT series_id, axis, at, CASE WHEN NOT i THEN pos WHEN pos > b AND pos > n THEN hi WHEN pos < b AND pos < n THEN lo ELSE pos END AS pos, seq
FROM (SELECT *, lag(pos) OVER (PARTITION BY series_id, axis, i ORDER BY at, seq) AS b, lead(pos) OVER (PARTITION BY series_id, axis, i ORDER BY at, seq) AS n,
        min(pos) OVER (PARTITION BY series_id, axis, i) AS lo, max(pos) OVER (PARTITION BY series_id, axis, i) AS hi
      FROM (SELECT *, coalesce(r BETWEEN min(CASE WHEN pos > 60 THEN r END) OVER {G} AND max(CASE WHEN pos > 60 THEN r END) OVER {G}, false) AS i
            FROM (SELECT *, row_number() OVER {S} AS r FROM points)))""")
)
def align_peaks_slice(spark: SparkSession, sf: str) -> DataFrame:
    """From the first point over 60 to the last, as the series itself; inside a slice its rows are neighbours."""
    return run_pipeline(points(spark, sf), [Step("align_peaks", selected=F.col("pos") > 60)])[0]


@query(on_points("""SELECT series_id, axis, at, CASE WHEN at BETWEEN 10000 AND 40000 THEN CASE WHEN pos < 30 THEN 0 WHEN pos > 70 THEN 100 ELSE pos END ELSE pos END AS pos, seq FROM points"""))
def threshold_clamp_range(spark: SparkSession, sf: str) -> DataFrame:
    return run_pipeline(points(spark, sf), [Step("threshold_clamp", {"lower": 30, "upper": 70}, between=(10_000, 40_000))])[0]


def _sections(mark: str) -> str:
    return on_points(f"""SELECT series_id, axis, at, CAST(coalesce(least(100, greatest(0, round_even(round(pos + mean - (a + z) / 2.0::DOUBLE, 6), 0))), pos) AS INTEGER) AS pos, seq
FROM (SELECT *, avg(p) OVER {G} AS mean, last_value(p IGNORE NULLS) OVER (PARTITION BY series_id, axis ORDER BY at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
    first_value(p IGNORE NULLS) OVER (PARTITION BY series_id, axis ORDER BY at, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS z
  FROM (SELECT *, CASE WHEN {mark} THEN pos END AS p FROM (SELECT *, lag(pos) OVER {S} AS b, lead(pos) OVER {S} AS n FROM points)))""")


@query(_sections("pos > b AND pos > n"))
def align_top_bottom(spark: SparkSession, sf: str) -> DataFrame:
    return X.align_top_bottom(points(spark, sf), "top")


@query(_sections("pos % 7 = 0"))
def align_sections(spark: SparkSession, sf: str) -> DataFrame:
    return X.align_sections(points(spark, sf), F.col("pos") % 7 == 0)


def _range(value: str) -> str:
    return on_points(f"SELECT series_id, axis, at, CAST({value} AS INTEGER) AS pos, seq FROM (SELECT *, min(pos) OVER {G} AS lo, max(pos) OVER {G} AS hi FROM points)")


@query(_range("CASE WHEN hi > lo THEN least(100, greatest(0, round_even(10 + (pos - lo) * 80 / (hi - lo)::DOUBLE, 0))) ELSE pos END"))
def fit_range(spark: SparkSession, sf: str) -> DataFrame:
    return X.fit_range(points(spark, sf), 10, 90)


@query(
    _range("""CASE WHEN (hi - lo) / 2.0::DOUBLE >= 0.5 THEN least(100, greatest(0, round_even(round(
  (lo + hi) / 2.0::DOUBLE + (pos - (lo + hi) / 2.0::DOUBLE) * (((hi - lo) / 2.0::DOUBLE + 10) / ((hi - lo) / 2.0::DOUBLE)), 9), 0))) ELSE pos END""")
)
def range_extend(spark: SparkSession, sf: str) -> DataFrame:
    return X.range_extend(points(spark, sf), 10)


@query(
    on_points("""SELECT series_id, axis, at, CAST(CASE WHEN hi > lo THEN least(90, greatest(20, round_even(round(20 + (pos - lo) / (hi - lo) * 70, 9), 0))) ELSE 55 END AS INTEGER) AS pos, seq
FROM points JOIN (SELECT series_id, axis, quantile_cont(pos, 0.1) AS lo, quantile_cont(pos, 0.9) AS hi FROM points GROUP BY ALL) USING (series_id, axis)""")
)
def scale_percentile_range(spark: SparkSession, sf: str) -> DataFrame:
    return X.scale_percentile_range(points(spark, sf), 20, 90)


@query(
    on_points(f"""SELECT series_id, axis, CASE WHEN c >= 3 THEN CAST(round_even(a + i * (z - a) / (c - 1)::DOUBLE, 0) AS BIGINT) ELSE at END AS at, pos, seq
FROM (SELECT *, row_number() OVER {S} - 1 AS i, count(*) OVER {G} AS c, min(at) OVER {G} AS a, max(at) OVER {G} AS z FROM points)""")
)
def equalize_times(spark: SparkSession, sf: str) -> DataFrame:
    return X.equalize_times(points(spark, sf))


@query(
    on_points(f"""SELECT series_id, axis, coalesce(CAST(round_even((b + n) / 2.0::DOUBLE, 0) AS BIGINT), at) AS at, pos, seq
FROM (SELECT *, lag(at) OVER {S} AS b, lead(at) OVER {S} AS n FROM points)""")
)
def center_in_time(spark: SparkSession, sf: str) -> DataFrame:
    return X.centre_in_time(points(spark, sf))


@query(
    on_points(f"""SELECT series_id, axis, CAST(CASE WHEN c < 2 THEN at WHEN at = t THEN 30000
    WHEN at < 30000 THEN CASE WHEN t <> a THEN round_even(round(a + (30000 - a) / (t - a)::DOUBLE * (at - a), 6), 0) ELSE at END
    ELSE CASE WHEN t <> z THEN round_even(round(z + (30000 - z) / (t - z)::DOUBLE * (at - z), 6), 0) ELSE at END END AS BIGINT) AS at, pos, seq
FROM (SELECT *, count(*) OVER {G} AS c, min(at) OVER {G} AS a, max(at) OVER {G} AS z, first_value(at) OVER (PARTITION BY series_id, axis ORDER BY abs(at - 30000), at) AS t FROM points)""")
)
def adjust_timing(spark: SparkSession, sf: str) -> DataFrame:
    return X.adjust_timing(points(spark, sf), 30000)


@query(
    on_points(f"""SELECT series_id, axis, CAST(CASE WHEN r = 1 THEN greatest(coalesce(b + 1, 0), least(coalesce(n - 1, 30000), 30000)) ELSE at END AS BIGINT) AS at, pos, seq
FROM (SELECT *, lag(at) OVER {S} AS b, lead(at) OVER {S} AS n, row_number() OVER (PARTITION BY series_id, axis ORDER BY abs(at - 30000), at, seq) AS r FROM points)""")
)
def snap_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return X.snap_nearest(points(spark, sf), 30000)


@query(
    on_points(f"""SELECT series_id, axis, CAST(CASE WHEN r = 1 AND c THEN greatest(coalesce(b + 1, 0), least(coalesce(n - 1, 30000), 30000)) ELSE at END AS BIGINT) AS at, pos, seq
FROM (SELECT *, row_number() OVER (PARTITION BY series_id, axis, c ORDER BY abs(at - 30000), at, seq) AS r FROM (
  SELECT *, seq % 3 = 0 AS c, lag(at) OVER {S} AS b, lead(at) OVER {S} AS n FROM points))""")
)
def snap_nearest_selected(spark: SparkSession, sf: str) -> DataFrame:
    return X.snap_nearest(points(spark, sf), 30000, F.col("seq") % 3 == 0)


@query(
    on_points(f"""SELECT series_id, axis, min(at) AS start, max(e) AS end, count(*) AS moves FROM (
  SELECT *, sum(CASE WHEN s0 IS NULL OR s0 <> s THEN 1 ELSE 0 END) OVER {S} AS run FROM (
    SELECT *, lag(s) OVER {S} AS s0 FROM (SELECT *, abs(lead(pos) OVER {S} - pos) < 25 AS s, lead(at) OVER {S} AS e FROM points) WHERE e IS NOT NULL))
WHERE s GROUP BY series_id, axis, run HAVING max(e) - min(at) >= 3000""")
)
def oscillation_runs(spark: SparkSession, sf: str) -> DataFrame:
    return X.oscillation_runs(points(spark, sf), 25, 3000)


@query(
    on_points("""SELECT p.series_id, p.axis, p.at, p.pos, p.seq, round(coalesce(p.q, CASE WHEN g.height > 0 THEN g.height ELSE 0.3 * 640 END), 6) AS ref
FROM (SELECT *, quantile_cont(CASE WHEN at // 9000 % 3 = 0 AND seq % 4 <> 1 THEN pos END, 0.95) OVER (PARTITION BY series_id, axis ORDER BY at RANGE BETWEEN 3000 PRECEDING AND CURRENT ROW) AS q FROM points) p
LEFT JOIN (SELECT DISTINCT series_id, at // 9000 AS segment, at // 9000 % 2 * 40 AS height FROM points WHERE series_id % 2 = 0) g ON g.series_id = p.series_id AND g.segment = p.at // 9000""")
)
def rolling_percentile_ref(spark: SparkSession, sf: str) -> DataFrame:
    """Heights that are missing for stretches; segments of even series have a height or none."""
    p = points(spark, sf)
    segment = F.floor(F.col("at") / 9000)
    heights = p.where("series_id % 2 = 0").select("series_id", segment.alias("segment"), (segment % 2 * 40).alias("height")).distinct()
    rows = p.withColumns({"segment": segment, "seen": F.when((segment % 3 == 0) & (F.col("seq") % 4 != 1), F.col("pos"))}).join(heights, ["series_id", "segment"], "left")
    out = X.rolling_percentile(rows, 3000, value="seen", otherwise=F.col("height"), size=640)
    return out.select("series_id", "axis", "at", "pos", "seq", F.round("ref", 6).alias("ref"))


@query(
    on_points("""SELECT series_id, axis, at, pos, seq, round(coalesce(avg(CASE WHEN pos > 0 THEN pos END) OVER (PARTITION BY series_id, axis ORDER BY at, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0), 6) AS height FROM points""")
)
def rolling_height(spark: SparkSession, sf: str) -> DataFrame:
    return X.rolling_height(points(spark, sf)).withColumn("height", F.round("height", 6))


@query(
    on_points("""SELECT series_id, axis, at, pos, seq, round(CASE WHEN s > 1e-9 THEN (pos - m) / s ELSE 0 END, 6) AS z FROM (
  SELECT *, avg(pos) OVER w AS m, stddev_pop(pos) OVER w AS s FROM points WINDOW w AS (PARTITION BY series_id, axis ORDER BY at, seq ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))""")
)
def zscore_signal(spark: SparkSession, sf: str) -> DataFrame:
    return X.zscore(points(spark, sf)).withColumn("z", F.round("z", 6))
