"""Queries of the sequential filters; SQL by recursion where a short state is enough."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.operators import sequential as Q
from kinetra.operators import windows as X
from kinetra.plans.base import last_wins, on_points, points, query, raw_points
from kinetra.plans.q_windows import ANCHORS

S = "(PARTITION BY series_id, axis ORDER BY at, seq)"
G = "(PARTITION BY series_id, axis)"


def _recursive(body: str) -> str:
    """``body`` with points numbered i from 1 as n, in a recursive statement."""
    return f"WITH RECURSIVE {on_points('').removeprefix('WITH ').strip()}, n AS (SELECT *, row_number() OVER {S} AS i, count(*) OVER {G} AS c FROM points), {body}"


@query(
    _recursive("""r AS (
  SELECT series_id, axis, i, at, pos, seq, true AS keep, at AS kept FROM n WHERE i = 1
  UNION ALL SELECT n.series_id, n.axis, n.i, n.at, n.pos, n.seq, n.at - r.kept >= 900, CASE WHEN n.at - r.kept >= 900 THEN n.at ELSE r.kept END
  FROM r JOIN n ON n.series_id = r.series_id AND n.axis = r.axis AND n.i = r.i + 1)
SELECT series_id, axis, at, pos, seq FROM r WHERE keep""")
)
def min_interval_filter(spark: SparkSession, sf: str) -> DataFrame:
    return Q.min_interval_filter(raw_points(spark, sf), 900)


@query(
    _recursive("""r AS (
  SELECT series_id, axis, i, at, pos, seq FROM n WHERE i = c
  UNION ALL SELECT * FROM (SELECT n.series_id, n.axis, n.i, n.at, n.pos, n.seq FROM r JOIN n ON n.series_id = r.series_id AND n.axis = r.axis AND n.i < r.i AND r.at - n.at >= 700
    QUALIFY row_number() OVER (PARTITION BY n.series_id, n.axis ORDER BY n.i DESC) = 1)
), k AS (SELECT *, row_number() OVER (PARTITION BY series_id, axis ORDER BY at, seq) AS j FROM r), l AS (
  SELECT series_id, axis, j, at, seq, pos FROM k WHERE j = 1
  UNION ALL SELECT k.series_id, k.axis, k.j, k.at, k.seq, CASE WHEN k.at > l.at AND abs(k.pos - l.pos) > 0.04::DOUBLE * (k.at - l.at)
    THEN CAST(least(100, greatest(0, round_even(l.pos + CASE WHEN k.pos > l.pos THEN 0.04::DOUBLE * (k.at - l.at) ELSE -0.04::DOUBLE * (k.at - l.at) END, 0))) AS INTEGER) ELSE k.pos END
  FROM l JOIN k ON k.series_id = l.series_id AND k.axis = l.axis AND k.j = l.j + 1)
SELECT series_id, axis, at, pos, seq FROM l""")
)
def speed_limit(spark: SparkSession, sf: str) -> DataFrame:
    return Q.speed_limit(points(spark, sf), 700, 0, 40)


@query(
    _recursive("""w AS (
  SELECT series_id, axis, i, c, at, pos, seq, coalesce(abs(p3 - pos) >= 20 AND abs(p2 - p1) <= 25 AND t3 > at AND
    greatest(abs(p1 - (pos + (p3 - pos) * ((t1 - at) / nullif(t3 - at, 0)::DOUBLE))), abs(p2 - (pos + (p3 - pos) * ((t2 - at) / nullif(t3 - at, 0)::DOUBLE)))) > 10, false) AS jerk
  FROM (SELECT *, lead(pos) OVER v AS p1, lead(pos, 2) OVER v AS p2, lead(pos, 3) OVER v AS p3, lead(at) OVER v AS t1, lead(at, 2) OVER v AS t2, lead(at, 3) OVER v AS t3
    FROM n WINDOW v AS (PARTITION BY series_id, axis ORDER BY i))
), r AS (
  SELECT * FROM w WHERE i = 1
  UNION ALL SELECT w.* FROM r JOIN w ON w.series_id = r.series_id AND w.axis = r.axis AND w.i = r.i + CASE WHEN r.jerk THEN 3 ELSE 1 END)
SELECT series_id, axis, at, pos, seq FROM r""")
)
def anti_jerk(spark: SparkSession, sf: str) -> DataFrame:
    return Q.anti_jerk(points(spark, sf), 25, 20, 10)


@query(
    _recursive("""r AS (
  SELECT series_id, axis, i, c, at, pos, seq, pos AS cur FROM n WHERE i = 1
  UNION ALL SELECT n.series_id, n.axis, n.i, n.c, n.at, n.pos, n.seq, CASE WHEN n.pos > 20 AND n.at > r.at AND abs(n.pos - r.cur) / (n.at - r.at)::DOUBLE * 1000 > 30
    THEN CAST(trunc(least(100, greatest(0, r.cur + CASE WHEN n.pos > r.cur THEN 30 * (n.at - r.at) / 1000::DOUBLE ELSE -(30 * (n.at - r.at) / 1000::DOUBLE) END))) AS INTEGER) ELSE n.pos END
  FROM r JOIN n ON n.series_id = r.series_id AND n.axis = r.axis AND n.i = r.i + 1)
SELECT series_id, axis, at, CASE WHEN s >= 2 THEN cur ELSE pos END AS pos, seq FROM (SELECT *, count(*) FILTER (WHERE pos > 20) OVER (PARTITION BY series_id, axis) AS s FROM r)""")
)
def speed_limit_selected(spark: SparkSession, sf: str) -> DataFrame:
    return Q.speed_limit_selected(points(spark, sf), F.col("pos") > 20, 30)


#: n with the neighbours' times and positions.
NEAR = f"m AS (SELECT *, lead(at) OVER {S} AS nt, lead(pos) OVER {S} AS np, lag(at) OVER {S} AS pt FROM n)"
NEXT = "r JOIN m n ON n.series_id = r.series_id AND n.axis = r.axis AND n.i = r.i + 1"


def _nearer(p: str, q: str, reach: str) -> str:
    """Of a point out of reach of another the place in reach, if it is the one that gives way."""
    return f"CASE WHEN abs({p} - {q}) > {reach} AND sign({p} - {q}) * ({p} + {q} - 100) <= 0 THEN {q} + sign({p} - {q}) * floor({reach}) ELSE {p} END"


@query(
    _recursive(f"""{NEAR}, r AS (
  SELECT series_id, axis, i, at, pos::DOUBLE AS pos, seq FROM m WHERE i = 1
  UNION ALL SELECT series_id, axis, i, at, CASE WHEN i = c THEN pos ELSE {_nearer('p1', 'q', '0.04::DOUBLE * (at - pt)')} END, seq
  FROM (SELECT n.*, r.pos AS q, {_nearer('n.pos', 'n.np', '0.04::DOUBLE * (n.nt - n.at)')} AS p1 FROM {NEXT}))
SELECT series_id, axis, at, CAST(pos AS INTEGER) AS pos, seq FROM r""")
)
def directional_speed_limit(spark: SparkSession, sf: str) -> DataFrame:
    return Q.directional_speed_limit(points(spark, sf), 40)


@query(
    _recursive(f"""{NEAR}, b AS (SELECT series_id, axis, min(pos) AS lo, max(pos) AS hi FROM (
    SELECT *, min(CASE WHEN at > 20000 THEN i END) OVER {G} AS f, count(*) FILTER (WHERE at > 20000) OVER {G} AS k FROM n) WHERE k > 1 AND i BETWEEN f - 4 AND f - 1 GROUP BY ALL),
  r AS (
  SELECT series_id, axis, i, at, pos, seq FROM m WHERE i = 1
  UNION ALL SELECT n.series_id, n.axis, n.i, n.at, CASE WHEN n.at <= 20000 OR b.lo IS NULL THEN n.pos WHEN n.pos > r.pos AND (n.i = n.c OR n.pos > n.np) THEN b.hi
    WHEN n.pos < r.pos AND (n.i = n.c OR n.pos < n.np) THEN b.lo ELSE n.pos END, n.seq
  FROM {NEXT} LEFT JOIN b ON b.series_id = n.series_id AND b.axis = n.axis)
SELECT series_id, axis, at, pos, seq FROM r""")
)
def continue_minmax(spark: SparkSession, sf: str) -> DataFrame:
    return Q.continue_minmax(points(spark, sf), F.col("at") > 20000)


@query(
    _recursive(f"""{NEAR}, r AS (
  SELECT series_id, axis, i, CASE WHEN pos > 40 THEN greatest(coalesce(pt + 1, 0), at + 700) ELSE at END AS at, pos, seq FROM m WHERE i = c
  UNION ALL SELECT n.series_id, n.axis, n.i, CASE WHEN n.pos > 40 THEN least(r.at - 1, greatest(coalesce(n.pt + 1, 0), n.at + 700)) ELSE n.at END, n.pos, n.seq
  FROM r JOIN m n ON n.series_id = r.series_id AND n.axis = r.axis AND n.i = r.i - 1)
SELECT series_id, axis, at, pos, seq FROM r""")
)
def nudge_time_selected(spark: SparkSession, sf: str) -> DataFrame:
    return Q.nudge_time_selected(points(spark, sf), F.col("pos") > 40, 700)


@query(
    _recursive("""r AS (
  SELECT series_id, axis, i, at, pos, seq, NULL::BIGINT AS a0, NULL::INTEGER AS p0, NULL::BIGINT AS oa, NULL::INTEGER AS op, NULL::BIGINT AS os FROM n WHERE i = 1
  UNION ALL SELECT series_id, axis, ni, na, np, ns, CASE WHEN d THEN a0 ELSE at END, CASE WHEN d THEN p0 ELSE pos END, CASE WHEN d THEN NULL ELSE at END, CASE WHEN d THEN NULL ELSE pos END, CASE WHEN d THEN NULL ELSE seq END
  FROM (SELECT r.*, n.i AS ni, n.at AS na, n.pos AS np, n.seq AS ns, coalesce((r.pos - r.p0) * (r.pos - n.pos) <= 0 AND abs((r.at - r.a0) * (n.pos - r.p0) - (n.at - r.a0) * (r.pos - r.p0)) <= 2 * (n.at - r.a0), false) AS d
    FROM r JOIN n ON n.series_id = r.series_id AND n.axis = r.axis AND n.i = r.i + 1))
SELECT series_id, axis, oa AS at, op AS pos, os AS seq FROM r WHERE oa IS NOT NULL
UNION ALL SELECT series_id, axis, at, pos, seq FROM r QUALIFY i = max(i) OVER (PARTITION BY series_id, axis)""")
)
def online_simplify(spark: SparkSession, sf: str) -> DataFrame:
    return Q.online_simplify(points(spark, sf), 2)


@query()
def rdp_simplify(spark: SparkSession, sf: str) -> DataFrame:
    return Q.rdp_simplify(points(spark, sf), 0.02)


@query()
def recording_simplify(spark: SparkSession, sf: str) -> DataFrame:
    return Q.recording_simplify(points(spark, sf), 2)


@query()
def visvalingam_simplify(spark: SparkSession, sf: str) -> DataFrame:
    return Q.visvalingam_simplify(points(spark, sf), 20000)


@query()
def keyframes(spark: SparkSession, sf: str) -> DataFrame:
    return Q.keyframes(points(spark, sf), 10)


@query()
def find_peaks_valleys(spark: SparkSession, sf: str) -> DataFrame:
    return Q.find_peaks_valleys(points(spark, sf), prominence=20, distance=3)


@query(
    on_points(f"""SELECT series_id, axis, CAST(at AS BIGINT) AS at, pos FROM anchors
UNION ALL SELECT series_id, axis, t, CAST(least(100, greatest(0, round_even(round(pos + (1 - cos((t - at) / (e - at)::DOUBLE * pi())) / 2 * (q - pos), 6), 0))) AS INTEGER) FROM (
  SELECT *, at + unnest(range(1, CAST(ceil((e - at) / 250.0) AS BIGINT))) * 250 AS t FROM (SELECT *, lead(at) OVER {S} AS e, lead(pos) OVER {S} AS q FROM anchors) WHERE e > at)""").replace(
        "\nSELECT series_id", f", {ANCHORS}\nSELECT series_id", 1
    )
)
def resample_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return Q.resample_peaks(points(spark, sf), 250)


@query(
    on_points(f"""SELECT series_id, axis, at, pos FROM points
UNION ALL SELECT series_id, axis, CAST(round_even(round(at + (e - at) * f, 6), 0) AS BIGINT), CAST(least(100, greatest(0, round_even(round(pos + f * f * (3 - 2 * f) * (q - pos), 6), 0))) AS INTEGER) FROM (
  SELECT *, j / k::DOUBLE AS f FROM (SELECT *, unnest(range(1, k)) AS j FROM (
    SELECT *, greatest(1, CAST(floor((e - at) / (200::DOUBLE / least(2.0, greatest(0.5, abs(q - pos) / (e - at)::DOUBLE * 1000 / 200)))) AS BIGINT)) AS k
    FROM (SELECT *, lead(at) OVER {S} AS e, lead(pos) OVER {S} AS q FROM points) WHERE e - at > 200)))""")
)
def inject_points(spark: SparkSession, sf: str) -> DataFrame:
    return Q.inject_points(points(spark, sf), 200, True, "cubic")


@query(
    on_points(f"""SELECT series_id, axis, at, pos, seq FROM (
  SELECT o.series_id, o.axis, g.at AS ga, o.at, o.pos, o.seq, round(abs(o.pos - (g.pos + (o.at - g.at) / (g.e - g.at)::DOUBLE * (g.q - g.pos))), 9) AS d FROM points o JOIN (
    SELECT * FROM (SELECT *, median(e - at) OVER {G} AS m, count(*) OVER {G} AS c FROM (
      SELECT * FROM (SELECT *, lead(at) OVER {S} AS e, lead(pos) OVER {S} AS q FROM points WHERE pos % 3 = 0) WHERE e > at)) WHERE c >= 2 AND e - at > m * 1.8) g
  ON o.series_id = g.series_id AND o.axis = g.axis AND o.at > g.at AND o.at < g.e)
QUALIFY row_number() OVER (PARTITION BY series_id, axis, ga ORDER BY d DESC, at, seq) = 1""")
)
def recover_strokes(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return Q.recover_strokes(p.where("pos % 3 = 0"), p)


@query(
    on_points("""SELECT series_id, axis, unnest([a2 + d, a2 + 2 * d]) AS at, unnest([p1, p2]) AS pos FROM (
  SELECT *, a2 - a1 AS d FROM (SELECT series_id, axis, max(at) FILTER (WHERE r = 2) AS a1, max(pos) FILTER (WHERE r = 2) AS p1, max(at) FILTER (WHERE r = 1) AS a2, max(pos) FILTER (WHERE r = 1) AS p2
    FROM (SELECT *, row_number() OVER (PARTITION BY series_id, axis ORDER BY at DESC, seq DESC) AS r FROM points WHERE at < 40000) GROUP BY ALL) WHERE a2 > a1) x
WHERE NOT EXISTS (SELECT 1 FROM points p WHERE p.series_id = x.series_id AND p.axis = x.axis AND (abs(p.at - (a2 + d)) <= 16 OR abs(p.at - (a2 + 2 * d)) <= 16))""")
)
def repeat_last_stroke(spark: SparkSession, sf: str) -> DataFrame:
    return Q.repeat_last_stroke(points(spark, sf), 40000)


@query(
    on_points(f"""SELECT series_id, axis, CAST(at AS BIGINT) AS at, CAST(pos AS INTEGER) AS pos FROM z WHERE NOT coalesce(pos > lv, false)
UNION ALL SELECT series_id, axis, CAST(round_even(round(ta + (lv - pa) / (pos - pa) * (at - ta), 6), 0) AS BIGINT), CAST(round_even(lv, 0) AS INTEGER) FROM z WHERE pos > lv AND pa < lv
UNION ALL SELECT series_id, axis, CAST(round_even(round(at + (lv - pos) / (pz - pos) * (tz - at), 6), 0) AS BIGINT), CAST(round_even(lv, 0) AS INTEGER) FROM z WHERE pos > lv AND pz < lv""").replace(
        "\nSELECT series_id",
        f""", z AS (SELECT p.*, lag(p.at) OVER w AS ta, lag(p.pos) OVER w AS pa, lead(p.at) OVER w AS tz, lead(p.pos) OVER w AS pz, a.pos + (b.pos - a.pos) / (b.at - a.at)::DOUBLE * (30000 - a.at) AS lv
  FROM points p LEFT JOIN (SELECT * FROM points WHERE at <= 30000 QUALIFY row_number() OVER (PARTITION BY series_id, axis ORDER BY at DESC, seq DESC) = 1) a USING (series_id, axis)
  LEFT JOIN (SELECT * FROM points WHERE at > 30000 QUALIFY row_number() OVER {S} = 1) b USING (series_id, axis)
  WINDOW w AS (PARTITION BY p.series_id, p.axis ORDER BY p.at, p.seq))\nSELECT series_id""",
        1,
    )
)
def clip_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return Q.clip_peaks(points(spark, sf), 30000)


@query(
    on_points("""SELECT series_id, axis, CAST(round_even(round(b1 + i * d, 6), 0) AS BIGINT) AS at, CAST(round_even((q3 + q1 + p1 + p3) / 4.0::DOUBLE, 0) AS INTEGER) AS pos FROM (SELECT *, unnest(range(1, n)) AS i FROM y)
UNION ALL SELECT series_id, axis, CAST(round_even(round(b2 + i * d, 6), 0) AS BIGINT), CAST(round_even((q2 + p2) / 2.0::DOUBLE, 0) AS INTEGER) FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM y)""").replace(
        "\nSELECT series_id",
        """, x AS (SELECT series_id, axis, max(at) FILTER (WHERE r = 1) AS b1, max(at) FILTER (WHERE r = 2) AS b2, max(at) FILTER (WHERE r = 3) AS b3, max(pos) FILTER (WHERE r = 1) AS q1,
    max(pos) FILTER (WHERE r = 2) AS q2, max(pos) FILTER (WHERE r = 3) AS q3 FROM (SELECT *, row_number() OVER (PARTITION BY series_id, axis ORDER BY at DESC, seq DESC) AS r FROM points WHERE at < 30000) WHERE r <= 3 GROUP BY ALL HAVING count(*) = 3),
  v AS (SELECT series_id, axis, max(at) FILTER (WHERE r = 1) AS a1, max(at) FILTER (WHERE r = 3) AS a3, max(pos) FILTER (WHERE r = 1) AS p1, max(pos) FILTER (WHERE r = 2) AS p2, max(pos) FILTER (WHERE r = 3) AS p3
    FROM (SELECT *, row_number() OVER (PARTITION BY series_id, axis ORDER BY at, seq) AS r FROM points WHERE at > 30000) WHERE r <= 3 GROUP BY ALL HAVING count(*) = 3),
  y AS (SELECT *, (a1 - b1) / n::DOUBLE AS d FROM (SELECT *, CAST(round_even(2 * (a1 - b1) / (b1 - b3 + a3 - a1)::DOUBLE + 0.5, 0) AS BIGINT) AS n FROM x JOIN v USING (series_id, axis) WHERE b1 - b3 + a3 - a1 > 0) WHERE n >= 1)
SELECT series_id""",
        1,
    )
)
def fill_gap(spark: SparkSession, sf: str) -> DataFrame:
    return Q.fill_gap(points(spark, sf), 30000)


@query()
def clean_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """A library of series: clean, simplify, stretch, limit; one shuffle by series serves all steps."""
    p = X.dynamic_amplify(X.drop_speed_artifacts(last_wins(raw_points(spark, sf, None)), 300))
    return Q.speed_limit(Q.keyframes(p, 8), 60, 0, 400)



