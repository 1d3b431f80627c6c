"""Queries of the joins, statistics, quality and comparison operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.operators import joins as J
from kinetra.operators import pointwise as P
from kinetra.operators import stats as A
from kinetra.plans.base import on_points, points, query, table

S = "(PARTITION BY series_id, axis ORDER BY at, seq)"
G = "(PARTITION BY series_id, axis)"


def chapters(spark: SparkSession, sf: str) -> DataFrame:
    """Six chapters of each series of even id, some of which overlap."""
    ids = points(spark, sf).where("series_id % 2 = 0").select("series_id").distinct()
    rows = ids.withColumn("ord", F.explode(F.array(*map(F.lit, range(6)))))
    start = F.col("ord") * 12000 + F.col("series_id") % 7 * 100
    return rows.select(
        "series_id", "ord", F.concat_ws("-", "series_id", "ord").alias("chapter_id"), start.alias("start_ms"),
        (start + 9000 + F.col("series_id") * F.col("ord") % 5 * 1500).alias("end_ms"),
        F.element_at(F.array(F.lit("calm"), F.lit("idle"), F.lit("fast")), F.col("ord") % 3 + 1).alias("label"),
    )


CHAPTERS = """chapters AS (
  SELECT series_id, o AS ord, series_id || '-' || o AS chapter_id, o * 12000 + series_id % 7 * 100 AS start_ms,
    o * 12000 + series_id % 7 * 100 + 9000 + series_id * o % 5 * 1500 AS end_ms, ['calm', 'idle', 'fast'][o % 3 + 1] AS label
  FROM (SELECT DISTINCT series_id FROM points WHERE series_id % 2 = 0), (SELECT unnest(range(6)) AS o)
)"""


def with_chapters(body: str) -> str:
    return on_points(f"SELECT 0").replace("\nSELECT 0", f", {CHAPTERS}\n{body}")  # noqa: F541


def _times(spark: SparkSession, sf: str) -> DataFrame:
    keys = points(spark, sf).select("series_id", "axis").distinct()
    none = keys.limit(0).unionByName(spark.range(1).select((-F.col("id") - 1).alias("series_id"), F.lit("stroke").alias("axis")))
    return keys.unionByName(none).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(71400), F.lit(1700)))).withColumn("t", F.col("t").cast("long"))


ASOF = f"""k AS (SELECT DISTINCT series_id, axis FROM points UNION ALL SELECT -1, 'stroke'), q AS (SELECT *, unnest(range(0, 71401, 1700)) AS t FROM k),
p AS (SELECT *, coalesce(lag(pos) OVER {S}, pos) AS before, coalesce(lead(pos) OVER {S}, pos) AS after, count(*) OVER {G} AS c FROM points),
j AS (
  SELECT q.series_id, q.axis, q.t, a.at AS ta, a.pos AS pa, a.before, z.at AS tz, z.pos AS pz, z.after, a.c, (q.t - a.at) / (z.at - a.at)::DOUBLE AS f
  FROM q ASOF LEFT JOIN p a ON q.series_id = a.series_id AND q.axis = a.axis AND q.t > a.at
  ASOF LEFT JOIN p z ON q.series_id = z.series_id AND q.axis = z.axis AND q.t <= z.at
)"""
_ENDS = "CASE WHEN pa IS NULL AND pz IS NULL THEN 50 WHEN pa IS NULL THEN pz WHEN pz IS NULL THEN pa ELSE {} END"


def _value_sql(value: str) -> str:
    v = _ENDS.format(value)
    return on_points("SELECT 0").replace(
        "\nSELECT 0", f", {ASOF}\nSELECT series_id, axis, t, round({v}, 6) AS value, CAST(least(100, greatest(0, round_even(round({v}, 9), 0))) AS INTEGER) AS pos FROM j"
    )


@query(_value_sql("pa + f * (pz - pa)"))
def value_at_linear(spark: SparkSession, sf: str) -> DataFrame:
    return J.value_at(points(spark, sf), _times(spark, sf)).withColumn("value", F.round("value", 6))


_SPLINE = """CASE WHEN c >= 3 THEN least(100, greatest(0, 0.5 * (2.0 * pa + (pz - before) * f + (2.0 * before - 5.0 * pa + 4.0 * pz - after) * f * f
  + (3.0 * pa - before - 3.0 * pz + after) * f * f * f))) ELSE pa + f * (pz - pa) END"""


@query(_value_sql(_SPLINE))
def value_at_spline(spark: SparkSession, sf: str) -> DataFrame:
    return J.value_at(points(spark, sf), _times(spark, sf), spline=True).withColumn("value", F.round("value", 6))


@query(on_points("SELECT series_id, axis, max(at) AS at, arg_max(pos, (at, seq)) AS pos FROM points GROUP BY ALL"))
def latest_value(spark: SparkSession, sf: str) -> DataFrame:
    return J.latest_value(points(spark, sf))


@query(
    on_points("""SELECT series_id, axis, arg_min(at, (abs(at - 33333), at)) AS closest, min(at) FILTER (WHERE at > 33333) AS next, max(at) FILTER (WHERE at < 33333) AS previous
FROM points GROUP BY ALL""")
)
def nearest_bookmark(spark: SparkSession, sf: str) -> DataFrame:
    return J.nearest(points(spark, sf), 33333)


@query(
    on_points("""SELECT series_id, axis, min(at) FILTER (WHERE f > 1000) AS next_at, max(at) FILTER (WHERE f < 1000) AS prev_at
FROM (SELECT *, round_even(at * 30.0::DOUBLE / 1000, 0) AS f FROM points) GROUP BY ALL""")
)
def next_prev_point(spark: SparkSession, sf: str) -> DataFrame:
    return J.next_prev_point(points(spark, sf), 1000, 30.0)


@query(
    with_chapters("""SELECT p.series_id, p.axis, p.at, p.pos, p.seq, c.chapter_id, c.label FROM points p
LEFT JOIN chapters c ON c.series_id = p.series_id AND p.at BETWEEN c.start_ms AND c.end_ms
QUALIFY row_number() OVER (PARTITION BY p.series_id, p.axis, p.seq ORDER BY c.ord) = 1""")
)
def chapter_at(spark: SparkSession, sf: str) -> DataFrame:
    return J.label_points(points(spark, sf), chapters(spark, sf))


@query(
    with_chapters("""SELECT series_id, axis, at, pos, seq FROM points p
WHERE NOT EXISTS (SELECT 1 FROM chapters c WHERE c.label = 'idle' AND c.series_id = p.series_id AND p.at BETWEEN c.start_ms AND c.end_ms)""")
)
def skip_idle_points(spark: SparkSession, sf: str) -> DataFrame:
    return J.points_outside(points(spark, sf), chapters(spark, sf).where("label = 'idle'"))


@query(
    with_chapters("""SELECT a.series_id, a.chapter_id AS first_id, b.chapter_id AS second_id FROM chapters a JOIN chapters b
ON a.series_id = b.series_id AND a.ord < b.ord AND greatest(a.start_ms, b.start_ms) <= least(a.end_ms, b.end_ms)""")
)
def chapters_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return J.chapters_overlap(chapters(spark, sf))


def _pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = points(spark, sf)
    return p.where("seq % 2 = 0"), p.where("seq % 2 = 1")


PAIRS = f"""m AS (SELECT * FROM points WHERE seq % 2 = 0), r AS (SELECT * FROM points WHERE seq % 2 = 1), span AS (
  SELECT series_id, axis, greatest(a1, a2) AS s, least(z1, z2) AS e, a2, z2
  FROM (SELECT series_id, axis, min(at) AS a1, max(at) AS z1 FROM m GROUP BY ALL) JOIN (SELECT series_id, axis, min(at) AS a2, max(at) AS z2 FROM r GROUP BY ALL) USING (series_id, axis)
), i AS (SELECT m.*, s, e, a2, z2 FROM m JOIN span USING (series_id, axis) WHERE e > s AND at BETWEEN s AND e), pairs AS (
  SELECT i.series_id, i.axis, i.at, i.pos, i.seq, i.s, i.e, i.a2, i.z2,
    CASE WHEN a.at IS NULL THEN z.pos WHEN z.at IS NULL THEN a.pos ELSE a.pos + (i.at - a.at) / (z.at - a.at)::DOUBLE * (z.pos - a.pos) END AS v
  FROM i ASOF LEFT JOIN r a ON i.series_id = a.series_id AND i.axis = a.axis AND i.at > a.at
  ASOF LEFT JOIN r z ON i.series_id = z.series_id AND i.axis = z.axis AND i.at <= z.at
)"""


def on_pairs(body: str) -> str:
    return with_chapters("SELECT 0").replace("\nSELECT 0", f", {PAIRS}\n{body}")


@query(on_pairs("SELECT series_id, axis, at, pos, seq, round(v, 6) AS ref_value FROM pairs"))
def compare_interpolated(spark: SparkSession, sf: str) -> DataFrame:
    rows = J.interpolated_pairs(*_pair(spark, sf))
    return rows.select("series_id", "axis", "at", "pos", "seq", F.round("ref_value", 6).alias("ref_value"))


@query(
    on_pairs("""SELECT series_id, axis, count(*) AS n, round(avg(abs(pos - v)), 6) AS mae,
  round(CASE WHEN stddev_pop(pos) > 1e-9 AND stddev_pop(v) > 1e-9 THEN corr(pos, v) ELSE 0 END, 6) AS correlation, round(avg(g), 6) AS speed_mae,
  round(CASE WHEN any_value(z2 - a2) > 0 THEN any_value(e - s) / any_value(z2 - a2)::DOUBLE ELSE 0 END, 6) AS coverage
FROM (SELECT *, abs(abs(pos - p0) / d * 1000 - abs(v - v0) / d * 1000) AS g FROM (
  SELECT *, lag(pos) OVER w AS p0, lag(v) OVER w AS v0, CASE WHEN at - lag(at) OVER w > 0 THEN at - lag(at) OVER w ELSE 1 END::DOUBLE AS d FROM pairs
  WINDOW w AS (PARTITION BY series_id, axis ORDER BY at, seq)))
GROUP BY ALL HAVING count(*) >= 2""")
)
def comparison_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = A.comparison_metrics(*_pair(spark, sf))
    return out.select("series_id", "axis", "n", *[F.round(c, 6).alias(c) for c in ("mae", "correlation", "speed_mae", "coverage")])


@query(
    on_pairs("""SELECT series_id, axis, chapter_id, count(*) AS n, round(avg(abs(pos - v)), 6) AS mae FROM pairs JOIN chapters c USING (series_id)
WHERE at BETWEEN start_ms AND end_ms AND end_ms > start_ms GROUP BY ALL HAVING count(*) >= 2""")
)
def per_chapter_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return A.per_chapter_mae(*_pair(spark, sf), chapters(spark, sf)).withColumn("mae", F.round("mae", 6))


@query(
    on_pairs("""SELECT series_id, axis, CAST(section AS BIGINT) AS section, min(f) AS start_ms, max(f) + 6000 AS end_ms, round(avg(mae), 6) AS mae FROM (
  SELECT *, sum(CASE WHEN p IS NULL OR f - (p + 6000) > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id, axis ORDER BY f) AS section FROM (
    SELECT *, lag(f) OVER (PARTITION BY series_id, axis ORDER BY f) AS p FROM (
      SELECT t.series_id, t.axis, t.f, avg(abs(pos - v)) AS mae FROM (
        SELECT series_id, axis, s + unnest(range(0, (e - s - 6000) // 3000 + 1)) * 3000 AS f FROM (SELECT DISTINCT series_id, axis, s, e FROM pairs WHERE e - s >= 6000)) t
      JOIN pairs x ON x.series_id = t.series_id AND x.axis = t.axis AND x.at BETWEEN t.f AND t.f + 6000
      GROUP BY t.series_id, t.axis, t.f HAVING count(*) >= 2 AND avg(abs(pos - v)) > 30)))
GROUP BY series_id, axis, section""")
)
def problem_sections(spark: SparkSession, sf: str) -> DataFrame:
    return A.problem_sections(*_pair(spark, sf), 6000, 30).withColumn("mae", F.round("mae", 6))


def _prominent(rows: str) -> str:
    """Extrema of prominence 5: the middles of level runs, held against the lowest point on either side up to a higher one."""
    key = "b.series_id = a.series_id AND b.axis = a.axis"
    side = lambda way, last: f"(SELECT min(b.v) FROM f b WHERE {key} AND b.sign = a.sign AND b.k {way} a.k AND NOT EXISTS (SELECT 1 FROM f c WHERE c.series_id = a.series_id AND c.axis = a.axis AND c.sign = a.sign AND c.v > a.v AND c.k {way} a.k AND c.k {last} b.k))"
    return f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY series_id, axis ORDER BY at, seq) AS i FROM {rows}),
  o AS (SELECT *, i - row_number() OVER (PARTITION BY series_id, axis, pos ORDER BY i) AS g FROM n),
  u AS (SELECT series_id, axis, pos, min(i) AS lo, max(i) AS hi FROM o GROUP BY series_id, axis, pos, g),
  f AS (SELECT series_id, axis, sign, pos * sign AS v, lo, hi, row_number() OVER (PARTITION BY series_id, axis, sign ORDER BY lo) AS k FROM u, (VALUES (1), (-1)) s(sign)),
  e AS (SELECT * FROM f QUALIFY v > lag(v) OVER (PARTITION BY series_id, axis, sign ORDER BY k) AND v > lead(v) OVER (PARTITION BY series_id, axis, sign ORDER BY k)),
  p AS (SELECT DISTINCT a.series_id, a.axis, (a.lo + a.hi) // 2 AS i FROM e a WHERE a.v - greatest({side('<', '>')}, {side('>', '<')}) >= 5)
SELECT n.series_id, n.axis, n.at, count(*) OVER (PARTITION BY n.series_id, n.axis) AS c FROM p JOIN n ON n.series_id = p.series_id AND n.axis = p.axis AND n.i = p.i"""


@query(
    on_pairs(f"""SELECT series_id, axis, lag, hits FROM (
  SELECT a.series_id, a.axis, a.at - b.at AS lag, count(*) AS hits FROM ({_prominent('m')}) a JOIN ({_prominent('r')}) b ON a.series_id = b.series_id AND a.axis = b.axis
  WHERE a.c >= 5 AND b.c >= 5 GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY series_id, axis ORDER BY hits DESC, lag) = 1""")
)
def signal_offset(spark: SparkSession, sf: str) -> DataFrame:
    return A.signal_offset(*_pair(spark, sf))


STATISTICS = on_points(f"""SELECT series_id, axis, count(*) AS num_points, (max(at) - min(at)) / 1000.0::DOUBLE AS duration_s, min(pos) AS min_pos, max(pos) AS max_pos,
  CAST(coalesce(sum(abs(dp)), 0) AS BIGINT) AS total_travel,
  CAST(CASE WHEN sum(CASE WHEN way <> was THEN 1 ELSE 0 END) > 0 THEN sum(CASE WHEN way <> was THEN 1 ELSE 0 END) WHEN sum(abs(dp)) > 0 THEN 1 ELSE 0 END AS BIGINT) AS num_strokes,
  round(CASE WHEN sum(CASE WHEN dp <> 0 AND dt > 0 THEN dt END) > 0 THEN sum(abs(dp)) / (sum(CASE WHEN dp <> 0 AND dt > 0 THEN dt END) / 1000.0::DOUBLE) ELSE 0 END, 6) AS avg_speed,
  round(CASE WHEN count(*) > 1 THEN sum(abs(dp)) / (count(*) - 1)::DOUBLE ELSE 0 END, 6) AS avg_intensity,
  round(coalesce(avg(CASE WHEN dt > 0 THEN dt END), 0), 6) AS avg_interval_ms,
  coalesce(min(CASE WHEN dt > 0 THEN dt END), -1) AS min_interval_ms, coalesce(max(CASE WHEN dt > 0 THEN dt END), -1) AS max_interval_ms
FROM (SELECT *, last_value(way IGNORE NULLS) OVER (PARTITION BY series_id, axis ORDER BY at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM (
  SELECT *, CASE WHEN dp <> 0 THEN sign(dp) END AS way FROM (SELECT *, lead(at) OVER {S} - at AS dt, lead(pos) OVER {S} - pos AS dp FROM points)))
GROUP BY series_id, axis""")


@query(STATISTICS)
def series_statistics(spark: SparkSession, sf: str) -> DataFrame:
    out = A.series_statistics(points(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_speed", "avg_intensity", "avg_interval_ms")})


QUALITY = f"""mv AS (
  SELECT *, CASE WHEN dt IS NOT NULL THEN abs(dp) / CASE WHEN dt > 0 THEN dt ELSE 1 END::DOUBLE * 1000 END AS v
  FROM (SELECT *, lead(at) OVER {S} - at AS dt, abs(lead(pos) OVER {S} - pos) AS dp FROM points)
), qs AS (
  SELECT series_id, axis, count(*) AS n, max(at) AS duration_ms, CASE WHEN max(at) > 0 THEN (max(at) - min(at)) / max(at)::DOUBLE * 100 END AS coverage_pct,
    avg(v) AS avg_speed, max(v) AS max_speed, min(pos) AS min_pos, max(pos) AS max_pos, avg(dt) AS avg_interval_ms, count(*) FILTER (WHERE v > 500) AS n_fast,
    count(*) FILTER (WHERE dp > 0 AND dp < 5) AS n_small, count(*) FILTER (WHERE dt < 20) AS n_close, count(*) FILTER (WHERE dt > 5000 AND dp > 5) AS n_far
  FROM mv GROUP BY ALL
), issues AS (
  SELECT series_id, axis, 'insufficient' AS category, 'ERROR' AS severity, n::DOUBLE AS number, NULL::BIGINT AS start, NULL::BIGINT AS finish FROM qs WHERE n < 2
  UNION ALL SELECT series_id, axis, 'speed_limit', CASE WHEN n_fast > 50 THEN 'ERROR' WHEN n_fast > 10 THEN 'WARNING' ELSE 'INFO' END, n_fast, NULL, NULL FROM qs WHERE n >= 2 AND n_fast > 0
  UNION ALL SELECT series_id, axis, 'dead_zone', 'INFO', max(e) - min(at), min(at), max(e) FROM (
    SELECT *, sum(CASE WHEN s0 IS NULL OR s0 <> s THEN 1 ELSE 0 END) OVER {S} AS run FROM (
      SELECT *, lag(s) OVER {S} AS s0 FROM (SELECT *, dp < 5 AS s, at + dt AS e FROM mv WHERE dt IS NOT NULL))) WHERE s GROUP BY series_id, axis, run HAVING max(e) - min(at) >= 5000
  UNION ALL SELECT series_id, axis, 'coverage', CASE WHEN coverage_pct < 50 THEN 'WARNING' ELSE 'INFO' END, coverage_pct, NULL, NULL FROM qs WHERE n >= 2 AND coverage_pct < 80
  UNION ALL SELECT series_id, axis, 'min_movement', CASE WHEN n_small / (n - 1)::DOUBLE * 100 > 10 THEN 'WARNING' ELSE 'INFO' END, n_small, NULL, NULL FROM qs
    WHERE n >= 2 AND (n_small / (n - 1)::DOUBLE * 100 > 10 OR n_small > 5)
  UNION ALL SELECT series_id, axis, 'interval_close', 'INFO', n_close, NULL, NULL FROM qs WHERE n >= 2 AND n_close > 0
  UNION ALL SELECT series_id, axis, 'interval_far', 'WARNING', dt, at, at + dt FROM (
    SELECT *, row_number() OVER {S} AS r FROM mv WHERE dt > 5000 AND dp > 5) WHERE r <= 5
)"""


def on_quality(body: str) -> str:
    return on_points("SELECT 0").replace("\nSELECT 0", f", {QUALITY}\n{body}")


@query(on_quality("SELECT * REPLACE (round(coverage_pct, 6) AS coverage_pct, round(avg_speed, 6) AS avg_speed, round(max_speed, 6) AS max_speed, round(avg_interval_ms, 6) AS avg_interval_ms) FROM qs"))
def quality_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = A.quality_stats(points(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("coverage_pct", "avg_speed", "max_speed", "avg_interval_ms")})


@query(on_quality("SELECT series_id, axis, category, severity, round(number, 6) AS number, start, finish AS \"end\" FROM issues"))
def quality_issues(spark: SparkSession, sf: str) -> DataFrame:
    return A.quality_issues(points(spark, sf)).withColumn("number", F.round("number", 6))


@query(
    on_quality("""SELECT p.series_id, p.axis, CAST(CASE WHEN one THEN 10 ELSE greatest(0, floor(100 - coalesce(lost, 0))) END AS INTEGER) AS score
FROM (SELECT DISTINCT series_id, axis FROM points) p LEFT JOIN (
  SELECT series_id, axis, bool_or(category = 'insufficient') AS one, sum(CASE severity WHEN 'ERROR' THEN CASE category WHEN 'insufficient' THEN 80 ELSE 20 END
    WHEN 'WARNING' THEN CASE category WHEN 'speed_limit' THEN least(30, number / 2) WHEN 'coverage' THEN 10 WHEN 'min_movement' THEN 5 WHEN 'interval_far' THEN 3 ELSE 2 END ELSE 1 END) AS lost
  FROM issues GROUP BY ALL) USING (series_id, axis)""")
)
def quality_score(spark: SparkSession, sf: str) -> DataFrame:
    return A.quality_score(points(spark, sf))


@query("""SELECT event_id, CASE WHEN o < 1000 / 30.0::DOUBLE AND g < 3 THEN 'gold' WHEN o < 66 AND g < 7 THEN 'green' WHEN o < 133 AND g < 15 THEN 'yellow' ELSE 'red' END AS class
FROM (SELECT event_id, event_id % 150 AS o, value % 20 AS g FROM events)""")
def classify_match(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", A.classify_match(F.col("event_id") % 150, F.col("value") % 20).alias("class"))


@query(
    on_points(f"""SELECT k.series_id, k.axis, k.c AS col, round(coalesce(abs(q - pos) / (e - at)::DOUBLE * 1000, 0), 6) AS speed
FROM (SELECT series_id, axis, unnest(range(0, 90)) AS c FROM (SELECT DISTINCT series_id, axis FROM points)) k
LEFT JOIN (SELECT * FROM (SELECT *, lead(at) OVER {S} AS e, lead(pos) OVER {S} AS q FROM points) WHERE e > at) s
  ON s.series_id = k.series_id AND s.axis = k.axis AND (k.c + 0.5) * 800 >= s.at AND (k.c + 0.5) * 800 < s.e""")
)
def heatmap_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return A.heatmap_buckets(points(spark, sf), 90, 72000).withColumn("speed", F.round("speed", 6))


@query(
    on_points(f"""SELECT series_id, axis, col, min(least(pos, q)) AS lo, max(greatest(pos, q)) AS hi FROM (
  SELECT *, unnest(range(least(59, at // 1200), least(59, e // 1200) + 1)) AS col FROM (SELECT *, coalesce(lead(at) OVER {S}, at) AS e, coalesce(lead(pos) OVER {S}, pos) AS q FROM points))
GROUP BY ALL""")
)
def envelope_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return A.envelope_buckets(points(spark, sf), 60, 72000)


@query(
    """SELECT user_id AS series_id, i // 8 AS bucket, max(abs(value - 50)) AS peak FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) GROUP BY ALL HAVING count(*) = 8"""
)
def waveform_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return A.waveform_peaks(samples(spark, sf), 8)


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """A signal ``(series_id, i, value)``: event values around 50 in time order."""
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf, "events").select(F.col("user_id").alias("series_id"), i.alias("i"), (F.col("value") - 50).alias("value"))


@query(
    on_points("""SELECT series_id, axis, count(*) AS points, count(*) FILTER (WHERE p <> pos) AS affected, count(*) FILTER (WHERE p <> pos AND p IN (0, 100)) AS clamped,
  min(pos) AS min_before, max(pos) AS max_before, min(p) AS min_after, max(p) AS max_after, round(avg(abs(p - pos)), 6) AS mean_change
FROM (SELECT *, CAST(least(100, greatest(0, round_even(50 + (pos - 50) * 1.25::DOUBLE, 0))) AS INTEGER) AS p FROM points) GROUP BY ALL""")
)
def filter_preview(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return A.filter_preview(p, P.amplify(p)).withColumn("mean_change", F.round("mean_change", 6))


def boxes(spark: SparkSession, sf: str, *more: Column) -> DataFrame:
    """Boxes from ``lineitem``: an order is a frame, its lines are boxes, the return flag their class; ``more`` columns of the table."""
    x1, y1 = F.col("l_quantity") * 8, F.col("l_discount") * 4000
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 100).alias("series_id"), F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("box_id"), F.col("l_returnflag").alias("class_name"),
        x1.alias("x1"), y1.alias("y1"), (x1 + 20 + F.col("l_tax") * 1000).alias("x2"), (y1 + 40 + F.col("l_linenumber") * 10).alias("y2"),
        (0.3 + F.col("l_discount") * 7).alias("confidence"), *more,
    )


BOXES = """boxes AS (
  SELECT l_orderkey % 100 AS series_id, l_orderkey AS frame_id, l_linenumber AS box_id, l_returnflag AS class_name, l_quantity * 8 AS x1, l_discount * 4000 AS y1,
    l_quantity * 8 + 20 + l_tax * 1000 AS x2, l_discount * 4000 + 40 + l_linenumber * 10 AS y2, 0.3 + l_discount * 7 AS confidence FROM lineitem
)"""


@query(
    f"""WITH {BOXES}, p AS (
  SELECT a.series_id, a.frame_id, a.box_id AS anchor_id, b.box_id, b.class_name,
    greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS s,
    (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS t,
    sqrt(((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) ** 2 + ((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) ** 2)
      / ((sqrt((a.x2 - a.x1) ** 2 + (a.y2 - a.y1) ** 2) + sqrt((b.x2 - b.x1) ** 2 + (b.y2 - b.y1) ** 2)) / 2) AS gap
  FROM boxes a JOIN boxes b USING (series_id, frame_id) WHERE a.class_name = 'R' AND b.class_name <> 'R')
SELECT series_id, frame_id, anchor_id, box_id, class_name, round(s / (t - s), 6) AS iou, round(gap, 6) AS gap FROM p WHERE s / (t - s) > 0.05 OR (s = 0 AND gap < 1)"""
)
def box_iou_contacts(spark: SparkSession, sf: str) -> DataFrame:
    return J.contacts(boxes(spark, sf), "R").withColumns({"iou": F.round("iou", 6), "gap": F.round("gap", 6)})


@query(
    f"""WITH {BOXES} SELECT series_id, frame_id, box_id, class_name, x1, y1, x2, y2, confidence FROM boxes WHERE class_name = 'A'
QUALIFY row_number() OVER (PARTITION BY series_id, frame_id ORDER BY (y1 + y2) / 2 DESC, (x2 - x1) * (y2 - y1) DESC, box_id, x1) = 1"""
)
def preferred_box(spark: SparkSession, sf: str) -> DataFrame:
    return J.preferred_box(boxes(spark, sf), "A")


@query(
    """SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderkey = orders.o_orderkey AND p.o_orderkey % 3 = 0
  AND p.o_orderstatus = 'F' AND p.o_orderpriority = '1-URGENT')"""
)
def skip_existing_jobs(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    jobs = o.select(F.col("o_orderkey").alias("path"), "o_custkey")
    outputs = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("author"), F.col("o_orderpriority").alias("version"))
    return J.skip_existing(jobs, outputs, 0, "F", "1-URGENT").select(F.col("path").alias("o_orderkey"), "o_custkey")


@query(
    """WITH e AS (SELECT p_name AS name, max(p_partkey) AS old FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1), i AS (SELECT p_name AS name, max(p_partkey) AS new FROM part WHERE p_partkey % 2 = 0 GROUP BY 1)
SELECT name, coalesce(old, new) AS value FROM e FULL JOIN i USING (name) UNION ALL SELECT name || '_1', new FROM e JOIN i USING (name)"""
)
def types_import(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    of = lambda cond: p.where(cond).groupBy(F.col("p_name").alias("name")).agg(F.max("p_partkey").alias("value"))
    return J.import_types(of("p_partkey % 3 <> 0"), of("p_partkey % 2 = 0"), "rename")
