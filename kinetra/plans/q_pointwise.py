"""Queries of the point-wise operators and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.functions import numbers as N
from kinetra.operators import pointwise as P
from kinetra.plans.base import AXES_SQL, on_points, points, query, table

OUT = ("series_id", "axis", "at", "pos", "seq")
C = "series_id, axis, at, pos, seq"


def _pos(expr: str) -> str:
    return on_points(f"SELECT series_id, axis, at, CAST({expr} AS INTEGER) AS pos, seq FROM points")


@query(_pos("least(100, greatest(0, round_even(50 + (pos - 50) * 1.25, 0)))"))
def amplify(spark: SparkSession, sf: str) -> DataFrame:
    return P.amplify(points(spark, sf))


@query(_pos("CASE WHEN at BETWEEN 10000 AND 50000 THEN least(100, greatest(0, round_even(40 + (pos - 40) * 1.7, 0))) ELSE pos END"))
def amplify_selected(spark: SparkSession, sf: str) -> DataFrame:
    return P.amplify(points(spark, sf), 1.7, 40, F.col("at").between(10000, 50000))


@query(_pos("100 - pos"))
def invert(spark: SparkSession, sf: str) -> DataFrame:
    return P.invert(points(spark, sf))


@query(_pos("CASE WHEN pos < 20 THEN 0 WHEN pos > 80 THEN 100 ELSE pos END"))
def threshold_clamp(spark: SparkSession, sf: str) -> DataFrame:
    return P.threshold_clamp(points(spark, sf))


@query(_pos("CASE WHEN pos > 90 THEN 50 ELSE pos END"))
def value_clamp(spark: SparkSession, sf: str) -> DataFrame:
    return P.value_clamp(points(spark, sf), 50, F.col("pos") > 90)


@query(_pos("least(100, greatest(0, pos - 15))"))
def nudge_value(spark: SparkSession, sf: str) -> DataFrame:
    return P.nudge_value(points(spark, sf), -3, 5)


@query(on_points("SELECT series_id, axis, at - 5000 AS at, pos, seq FROM points WHERE at >= 5000"))
def time_shift(spark: SparkSession, sf: str) -> DataFrame:
    return P.time_shift(points(spark, sf), -5000)


@query(on_points("SELECT series_id, axis, at + greatest(-5000, -min(at) OVER (PARTITION BY series_id, axis)) AS at, pos, seq FROM points"))
def shift_series_time(spark: SparkSession, sf: str) -> DataFrame:
    return P.shift_series_time(points(spark, sf), -5000)


@query(on_points("SELECT series_id, axis, greatest(0, at - CAST(round_even(45 / 30.0 * 1000, 0) AS BIGINT)) AS at, pos, seq FROM points"))
def nudge_all_frames(spark: SparkSession, sf: str) -> DataFrame:
    return P.nudge_frames(points(spark, sf), -45, 30.0)


CHAPTERS_12S = "(SELECT DISTINCT series_id, at // 12000 AS k FROM points)"


@query(on_points("SELECT series_id, axis, CASE WHEN (at // 12000) % 2 = 0 THEN at + 667 ELSE at END AS at, pos, seq FROM points"))
def nudge_chapter_frames(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    k = F.floor(F.col("at") / 12000).cast("long")
    chapters = p.select("series_id", k.alias("k")).where("k % 2 = 0").distinct()
    chapters = chapters.select("series_id", (F.col("k") * 12000).alias("start_ms"), (F.col("k") * 12000 + 11999).alias("end_ms"))
    return P.nudge_frames(p, 20, 30.0, chapters)


@query(
    on_points("""SELECT series_id, axis, at, f AS frame, CAST(round_even(f / 23.976 * 1000, 0) AS BIGINT) AS snapped
FROM (SELECT *, CAST(round_even(at * 23.976::DOUBLE / 1000, 0) AS BIGINT) AS f FROM points)""").replace("/ 23.976 ", "/ 23.976::DOUBLE ")
)
def frame_ms_convert(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("at")
    return points(spark, sf).select("series_id", "axis", "at", N.ms_to_frame(at, 23.976).alias("frame"), N.snap_to_frame(at, 23.976).alias("snapped"))


@query(
    on_points("""SELECT series_id, seq, f AS frame,
  printf('%02d:%02d:%02d.%03d', CAST(floor(s / 3600) AS BIGINT), CAST(floor((s % 3600) / 60) AS BIGINT), CAST(floor(s % 60) AS BIGINT),
         CAST(floor((s - floor(s)) * 1000) AS BIGINT)) AS timecode
FROM (SELECT *, f / 30.0::DOUBLE AS s FROM (SELECT *, at * 37 AS f FROM points))""")
)
def timecode_format(spark: SparkSession, sf: str) -> DataFrame:
    f = F.col("at") * 37
    return points(spark, sf).select("series_id", "seq", f.alias("frame"), N.timecode(f, 30.0).alias("timecode"))


@query(
    on_points("""SELECT series_id, seq, CASE WHEN at % 7 = 0 THEN 0 ELSE
  CAST(round_even(((at // 3600) * 3600 + (at // 60 % 60) * 60 + at % 60 + (at % 1000) / 1000.0::DOUBLE) * 25, 0) AS BIGINT) END AS frame
FROM points""")
)
def timecode_parse(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("at")
    whole = lambda c: F.floor(c).cast("long")
    text = F.format_string("%02d:%02d:%02d.%03d", whole(at / 3600), whole(at / 60) % 60, at % 60, at % 1000)
    text = F.when(at % 7 == 0, F.concat(text, F.lit(":x"))).otherwise(text)
    return points(spark, sf).select("series_id", "seq", N.timecode_frames(text, 25.0).alias("frame"))


@query(
    on_points("""SELECT series_id, seq, CAST(CASE at % 5 WHEN 0 THEN at WHEN 1 THEN round_even((pos + 0.5) * 24, 0)
  WHEN 2 THEN round_even((pos * 60 + at % 60 + 0.25) * 24, 0) WHEN 3 THEN (pos * 3600 + 2 * 60 + 7) * 24 ELSE -1 END AS BIGINT) AS frame
FROM points""")
)
def time_input_parse(spark: SparkSession, sf: str) -> DataFrame:
    at, pos = F.col("at"), F.col("pos")
    kind = at % 5
    text = (
        F.when(kind == 0, at.cast("string"))
        .when(kind == 1, F.concat(pos.cast("string"), F.lit(".5 ")))
        .when(kind == 2, F.concat_ws(":", pos.cast("string"), F.concat((at % 60).cast("string"), F.lit(".25"))))
        .when(kind == 3, F.concat(pos.cast("string"), F.lit(":2:7")))
        .otherwise(F.lit("1:2:3:4"))
    )
    return points(spark, sf).select("series_id", "seq", N.time_input_frames(text, 24.0).alias("frame"))


@query("""SELECT user_id, event_id, event_type AS axis, CASE event_type WHEN 'stroke' THEN '' ELSE '.' || event_type END AS suffix,
  [NULL, 'L0', 'R1', 'R2', 'R0', 'L1', 'L2', 'V0', 'V1'][CAST(event_id % 9 AS INTEGER) + 1] AS code,
  [NULL, 'stroke', 'roll', 'pitch', 'twist', 'sway', 'surge', 'vib', 'pump'][CAST(event_id % 9 AS INTEGER) + 1] AS of_code
FROM events""")
def axis_lookup(spark: SparkSession, sf: str) -> DataFrame:
    from kinetra.schema import AXES

    name = F.element_at(F.array(F.lit("none"), *[F.lit(a[0]) for a in AXES]), (F.col("event_id") % 9 + 1).cast("int"))
    code = N.axis_code(name)
    return table(spark, sf, "events").select(
        "user_id", "event_id", F.col("event_type").alias("axis"), N.axis_suffix(F.col("event_type")).alias("suffix"), code.alias("code"), N.axis_of_code(code).alias("of_code")
    )


@query(on_points(f"SELECT {C} FROM points WHERE at BETWEEN 12000 AND 24000"))
def range_query(spark: SparkSession, sf: str) -> DataFrame:
    return P.in_range(points(spark, sf), 12000, 24000)


@query(on_points(f"SELECT {C} FROM points WHERE at BETWEEN 12000 AND 24000 AND pos BETWEEN 30 AND 60"))
def box_query(spark: SparkSession, sf: str) -> DataFrame:
    return P.in_box(points(spark, sf), 12000, 24000, 30, 60)


@query(on_points("SELECT series_id, axis, CAST(greatest(0, round_even(round_even((at - 40) / 125.0::DOUBLE, 0) * 125.0::DOUBLE + 40, 0)) AS BIGINT) AS at, pos, seq FROM points"))
def snap_to_grid(spark: SparkSession, sf: str) -> DataFrame:
    return P.snap_to_grid(points(spark, sf), P.beat_step(120, 4), 40)


@query(f"WITH {AXES_SQL}\nSELECT {C} FROM points WHERE NOT (axis = 'click' AND at BETWEEN 1000 AND 40000)")
def clear_points(spark: SparkSession, sf: str) -> DataFrame:
    return P.clear_points(points(spark, sf, None), F.col("at").between(1000, 40000), "click").select(*OUT)


@query(on_points(f"SELECT {C} FROM points WHERE at <= 30000"))
def select_relative(spark: SparkSession, sf: str) -> DataFrame:
    return P.relative_to(points(spark, sf), 30000, before=True)


@query(
    on_points(f"""SELECT {C} FROM (SELECT *, min(CASE WHEN s THEN at END) OVER w AS a, max(CASE WHEN s THEN at END) OVER w AS b
  FROM (SELECT *, pos > 80 AS s FROM points) WINDOW w AS (PARTITION BY series_id, axis))
WHERE a IS NULL OR at < a OR at > b OR s""")
)
def isolate_selection(spark: SparkSession, sf: str) -> DataFrame:
    return P.isolate(points(spark, sf), F.col("pos") > 80)


PATTERN = [("swing", 0, 10), ("swing", 300, 95), ("swing", 700, 20), ("tap", 0, 50), ("tap", 125, 85)]


@query(
    on_points("""SELECT p.series_id, p.axis, t.name, CAST(round_even(p.at + t.at / 1.5::DOUBLE, 0) AS BIGINT) AS at,
  CAST(least(100, greatest(0, round_even(50 + (t.pos - 50) * 1.2::DOUBLE, 0))) AS INTEGER) AS pos
FROM points p JOIN (VALUES ('swing', 0, 10), ('swing', 300, 95), ('swing', 700, 20), ('tap', 0, 50), ('tap', 125, 85)) t(name, at, pos)
  ON t.name = CASE WHEN p.pos > 50 THEN 'swing' ELSE 'tap' END
WHERE p.pos % 10 = 3""")
)
def pattern_apply(spark: SparkSession, sf: str) -> DataFrame:
    pattern = spark.createDataFrame(PATTERN, "name string, at long, pos int")
    starts = points(spark, sf).where("pos % 10 = 3").select("series_id", "axis", F.when(F.col("pos") > 50, "swing").otherwise("tap").alias("name"), F.col("at").alias("start"))
    return P.apply_pattern(starts, pattern, 1.5, 1.2)


def _colour_sql() -> str:
    parts = []
    for k, name in enumerate(("r", "g", "b", "a")):
        when = f"WHEN s > 400 THEN {N.OVERSPEED[k]}::DOUBLE "
        for (p, low), (q, high) in zip(N.SPEED_STOPS, N.SPEED_STOPS[1:], strict=False):
            e = f"{low[k]}::DOUBLE + {high[k] - low[k]!r}::DOUBLE * (t - {p}::DOUBLE) / {q - p!r}::DOUBLE"
            when += f"WHEN t < {q} THEN {e} " if q < 1 else f"ELSE {e}"
        parts.append(f"round(CASE {when} END, 9) AS {name}")
    return ", ".join(parts)


@query(f"SELECT event_id, {_colour_sql()} FROM (SELECT event_id, abs(value) AS s, abs(value) / 400 AS t FROM events)")
def speed_to_color(spark: SparkSession, sf: str) -> DataFrame:
    colour = {k: F.round(c, 9) for k, c in N.speed_colour(F.col("value")).items()}
    return table(spark, sf, "events").select("event_id", *[c.alias(k) for k, c in colour.items()])


def _angle_sql() -> str:
    x, y, c = (lambda i: f"e[{3 * i + 1}]"), (lambda i: f"e[{3 * i + 2}]"), (lambda i: f"abs(e[{3 * i + 3}])")
    hips, both = f"least({c(11)}, {c(12)}) >= 0.3", f"least({c(11)}, {c(12)}, {c(5)}, {c(6)}) >= 0.3"
    twist = f"atan2({y(6)} - {y(5)}, {x(6)} - {x(5)}) - atan2({y(12)} - {y(11)}, {x(12)} - {x(11)})"
    return f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), w AS (
  SELECT vec_id, CASE WHEN {hips} THEN degrees(atan2({y(12)} - {y(11)}, {x(12)} - {x(11)})) END AS roll,
    CASE WHEN {both} THEN degrees(atan2(({x(5)} + {x(6)}) / 2 - ({x(11)} + {x(12)}) / 2, -(({y(5)} + {y(6)}) / 2 - ({y(11)} + {y(12)}) / 2))) END AS pitch,
    CASE WHEN {both} THEN {twist} END AS tw, CASE WHEN {both} THEN ({x(11)} + {x(12)}) / 2 - ({x(5)} + {x(6)}) / 2 END AS sway
  FROM v)
SELECT vec_id, round(roll, 6) AS roll, round(pitch, 6) AS pitch,
  round(degrees(CASE WHEN tw > pi() THEN tw - 2 * pi() WHEN tw < -pi() THEN tw + 2 * pi() ELSE tw END), 6) AS twist, round(sway, 6) AS sway,
  CASE WHEN roll IS NOT NULL THEN CAST(least(100, greatest(0, round_even((roll / 45 + 0.5) * 100, 0))) AS INTEGER) END AS pos FROM w"""


@query(_angle_sql())
def pose_angles(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    keypoint = lambda i: F.struct(e[3 * i].alias("x"), e[3 * i + 1].alias("y"), F.abs(e[3 * i + 2]).alias("conf"))
    rows = table(spark, sf, "embeddings").select("vec_id", F.array(*[keypoint(i) for i in range(17)]).alias("k"))
    angles = N.pose_angles(F.col("k"))
    rows = rows.select("vec_id", *[c.alias(k) for k, c in angles.items()])
    pos = F.when(F.col("roll").isNotNull(), N.angle_to_pos(F.col("roll")))
    return rows.select("vec_id", *[F.round(k, 6).alias(k) for k in angles], pos.alias("pos"))


@query("""SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'al') OR contains(lower(p_brand), 'al') ORDER BY 1""")
def type_search(spark: SparkSession, sf: str) -> DataFrame:
    has = lambda c: F.lower(c).contains("AL".lower())
    return table(spark, sf, "part").where(has("p_name") | has("p_brand")).select("p_partkey", "p_name", "p_brand").orderBy("p_partkey")


@query("SELECT DISTINCT p_type FROM part ORDER BY 1")
def type_categories(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_type").distinct().orderBy("p_type")
