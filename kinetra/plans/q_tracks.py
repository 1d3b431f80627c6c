"""Queries from detections and signals to motion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetra.operators import editing as E
from kinetra.operators import tracks as T
from kinetra.operators.derived import chapters_relabel as chapters_relabel_of
from kinetra.operators.locks import Rules
from kinetra.operators.locks import anchor_lock as anchor_lock_of
from kinetra.operators.locks import contact_lock as contact_lock_of
from kinetra.operators.tracking import Gates
from kinetra.operators.tracking import track_boxes as track_boxes_of
from kinetra.plans.base import points, query, table
from kinetra.plans.q_joins import BOXES, boxes, samples

R6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})


def nested(spark: SparkSession, sf: str) -> DataFrame:
    """Frames with nested detections, one of each seven boxes broken."""
    b = boxes(spark, sf)
    bbox = F.when(F.col("box_id") == 7, F.array("x2", "y1", "x1", "y2")).otherwise(F.array("x1", "y1", "x2", "y2"))
    d = F.struct(bbox.alias("bbox"), "confidence", F.lit(0).alias("class_id"), "class_name")
    return b.groupBy("series_id", "frame_id").agg(F.sort_array(F.collect_list(F.struct("box_id", "x1", d.alias("d")))).alias("r")).select("series_id", "frame_id", F.col("r.d").alias("detections"))


@query(
    f"""WITH {BOXES}, v AS (SELECT series_id, frame_id, class_name, confidence, CASE WHEN box_id = 7 THEN 0 ELSE x1 END AS x1, CASE WHEN box_id = 7 THEN 0 ELSE y1 END AS y1,
  CASE WHEN box_id = 7 THEN 0 ELSE x2 END AS x2, CASE WHEN box_id = 7 THEN 0 ELSE y2 END AS y2 FROM boxes WHERE class_name <> 'N')
SELECT series_id, frame_id, class_name, round(confidence, 6) AS confidence, round(x2 - x1, 6) AS w, round(y2 - y1, 6) AS h, round((x2 - x1) * (y2 - y1), 4) AS area,
  round(x1 + (x2 - x1) / 2, 6) AS cx, round(y1 + (y2 - y1) / 2, 6) AS cy, round((x2 - x1) * (y2 - y1) / (640 * 480) * 100, 4) AS area_pct FROM v"""
)
def explode_detections(spark: SparkSession, sf: str) -> DataFrame:
    out = R6(T.explode_detections(nested(spark, sf), 640, 480, ["N"]), "confidence", "w", "h", "cx", "cy")
    return out.select("series_id", "frame_id", "class_name", "confidence", "w", "h", F.round("area", 4).alias("area"), "cx", "cy", F.round("area_pct", 4).alias("area_pct"))


@query(f"WITH {BOXES} SELECT series_id, frame_id, box_id, class_name, x1 FROM boxes WHERE frame_id BETWEEN 1000 AND 5000")
def frame_range_read(spark: SparkSession, sf: str) -> DataFrame:
    return T.frame_range(boxes(spark, sf), 1000, 5000).select("series_id", "frame_id", "box_id", "class_name", "x1")


@query(f"WITH {BOXES} SELECT series_id, count(*) AS n, min(frame_id) AS first_frame, max(frame_id) AS last_frame FROM boxes GROUP BY 1")
def frame_extent(spark: SparkSession, sf: str) -> DataFrame:
    return T.frame_extent(boxes(spark, sf))


@query(
    """WITH f AS (SELECT user_id AS series_id, event_id // 40 AS frame_id, event_id AS seq, CASE WHEN value > 30 THEN event_type END AS pose FROM events),
o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY series_id, frame_id ORDER BY seq) = 1),
e AS (SELECT series_id, unnest(range(min(frame_id), max(frame_id) + 1)) AS frame_id FROM o GROUP BY series_id)
SELECT series_id, frame_id, last_value(pose IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pose FROM e LEFT JOIN o USING (series_id, frame_id)"""
)
def densify_frames_ffill(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    rows = e.select(F.col("user_id").alias("series_id"), F.floor(F.col("event_id") / 40).cast("long").alias("frame_id"), F.col("event_id").alias("seq"), F.when(F.col("value") > 30, F.col("event_type")).alias("pose"))
    return T.densify(rows, "pose")


@query(
    f"""WITH {BOXES}, a AS (SELECT * FROM boxes WHERE class_name = 'R' QUALIFY row_number() OVER (PARTITION BY series_id, frame_id ORDER BY confidence DESC, box_id, x1 DESC) = 1)
SELECT b.series_id, b.frame_id, count(*) FILTER (WHERE b.class_name <> 'R') AS contacts, round(any_value((a.y1 + a.y2) / 2 / 480), 6) AS anchor_y,
  round(any_value((a.x2 - a.x1) * (a.y2 - a.y1) / (480 * 480)), 6) AS anchor_area
FROM boxes b LEFT JOIN a USING (series_id, frame_id) GROUP BY ALL"""
)
def detection_parse(spark: SparkSession, sf: str) -> DataFrame:
    """The SQL's order leaves lines of one order, number, quantity and discount equal; the first in the table counts."""
    return R6(T.detection_parse(boxes(spark, sf, F.col("_metadata.row_index").alias("place")), "R", 480, F.col("place")), "anchor_y", "anchor_area")


@query(f"WITH {BOXES} SELECT series_id, frame_id, CASE WHEN bool_or(class_name = 'A') THEN 'first' ELSE 'second' END AS label FROM boxes WHERE class_name IN ('A', 'N') GROUP BY ALL")
def label_frame(spark: SparkSession, sf: str) -> DataFrame:
    return T.label_frames(boxes(spark, sf).where("class_name <> 'R'"), {"A": (2, "first"), "N": (1, "second")})


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Three spans of frames in each series of boxes, the middle one idle."""
    span = boxes(spark, sf).groupBy("series_id").agg(F.max("frame_id").alias("m"))
    k = F.explode(F.array(*map(F.lit, range(3)))).alias("k")
    third = F.floor(F.col("m") / 3).cast("long")
    return span.select("series_id", "m", k).select("series_id", (third * F.col("k")).alias("start_frame"), (third * (F.col("k") + 1) - 1).alias("end_frame"), F.when(F.col("k") == 1, "idle").otherwise("busy").alias("label"))


SEGMENTS = """segs AS (SELECT series_id, m // 3 * k AS start_frame, m // 3 * (k + 1) - 1 AS end_frame, CASE k WHEN 1 THEN 'idle' ELSE 'busy' END AS label
  FROM (SELECT series_id, max(frame_id) AS m, unnest([0, 1, 2]) AS k FROM boxes GROUP BY series_id))"""


@query(
    f"""WITH {BOXES}, {SEGMENTS}, c AS (SELECT series_id, start_frame, end_frame, class_name, count(*) AS n, avg((y1 + y2) / 2) AS my, avg((x2 - x1) * (y2 - y1)) AS ma
  FROM boxes JOIN segs USING (series_id) WHERE frame_id BETWEEN start_frame AND end_frame GROUP BY ALL)
SELECT series_id, start_frame, end_frame, class_name, n, round(my, 4) AS mean_y, round(ma, 4) AS mean_area, round(n / sum(n) OVER (PARTITION BY series_id, start_frame, end_frame), 6) AS share FROM c"""
)
def segment_spatial_vote(spark: SparkSession, sf: str) -> DataFrame:
    out = T.spatial_vote(boxes(spark, sf), segments(spark, sf))
    return R6(out.withColumns({"mean_y": F.round("mean_y", 4), "mean_area": F.round("mean_area", 4)}), "share")


#: Rules of the kinds there are: a class alone, a share or an area, two classes against each other, a class without others.
RULES = [
    T.LabelRule("first", has=("A",), some=(T.When("A", "share", True, 0.4), T.When("A", "mean_area", True, 12_000))),
    T.LabelRule("second", has=("N", "R"), every=(T.When("N", "mean_y", False, "R"),)),
    T.LabelRule("third", has=("R",), lacks=("A",), every=(T.When("R", "mean_y", True, 200), T.When("R", "mean_area", True, 5_000))),
]
NAMES = {"R": "by R", "A": "by A", "N": "by N"}
VOTE = f"""{BOXES}, {SEGMENTS}, t AS (SELECT s.series_id, s.start_frame, s.end_frame, s.label AS old, count(b.class_name) AS n, count(*) FILTER (WHERE class_name = 'A') AS a, count(*) FILTER (WHERE class_name = 'N') AS nn, count(*) FILTER (WHERE class_name = 'R') AS r,
  avg((x2 - x1) * (y2 - y1)) FILTER (WHERE class_name = 'A') AS aa, avg((x2 - x1) * (y2 - y1)) FILTER (WHERE class_name = 'R') AS ra, avg((y1 + y2) / 2) FILTER (WHERE class_name = 'N') AS ny, avg((y1 + y2) / 2) FILTER (WHERE class_name = 'R') AS ry
  FROM segs s LEFT JOIN boxes b ON b.series_id = s.series_id AND b.frame_id BETWEEN s.start_frame AND s.end_frame AND class_name IN ('A', 'N', 'R') GROUP BY ALL),
l AS (SELECT series_id, start_frame, end_frame, old, CASE WHEN n < 3 THEN NULL WHEN a > 0 AND (a / n > 0.4 OR aa > 12000) THEN 'first' WHEN nn > 0 AND r > 0 AND ny < ry THEN 'second'
  WHEN r > 0 AND a = 0 AND ry > 200 AND ra > 5000 THEN 'third' WHEN r >= a AND r >= nn THEN 'by R' WHEN a >= nn THEN 'by A' ELSE 'by N' END AS label FROM t)"""


@query(f"WITH {VOTE} SELECT series_id, start_frame, end_frame, label FROM l")
def segment_spatial_label(spark: SparkSession, sf: str) -> DataFrame:
    return T.spatial_label(boxes(spark, sf), segments(spark, sf), RULES, NAMES)


@query(
    f"""WITH {VOTE}, m AS (SELECT series_id, start_frame, end_frame, coalesce(CASE WHEN old <> 'idle' OR series_id % 3 = 0 THEN label END, old) AS label FROM l),
r AS (SELECT *, sum(CASE WHEN b IS NOT DISTINCT FROM label THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY start_frame) AS run FROM (SELECT *, lag(label) OVER (PARTITION BY series_id ORDER BY start_frame) AS b FROM m))
SELECT series_id, min(start_frame) AS start_frame, max(end_frame) AS end_frame, any_value(label) AS label FROM r GROUP BY series_id, run"""
)
def chapters_relabel(spark: SparkSession, sf: str) -> DataFrame:
    """Segments relabelled by the rules and joined again; every third series has no idle ones."""
    s = segments(spark, sf)
    idle = F.when((F.col("series_id") % 3 == 0) & (F.col("label") == "idle"), "busy").otherwise(F.col("label"))
    labels = T.spatial_label(boxes(spark, sf), s, RULES, NAMES)
    out = chapters_relabel_of(s.withColumn("_old", F.col("label")).withColumn("label", idle).drop("_old"), labels, ["idle"])
    return out


@query(
    f"""WITH {BOXES}, {SEGMENTS}, h AS (
  SELECT s.series_id, s.start_frame, s.end_frame, s.label, quantile_cont(b.y2 - b.y1, 0.95) AS p FROM segs s LEFT JOIN boxes b ON b.series_id = s.series_id AND b.frame_id BETWEEN s.start_frame AND s.end_frame
  GROUP BY s.series_id, s.start_frame, s.end_frame, s.label)
SELECT series_id, start_frame, end_frame, label, round(CASE WHEN label = 'idle' THEN 0 ELSE coalesce(p, 128) * 0.65 END, 6) AS reach FROM h"""
)
def segment_height_p95(spark: SparkSession, sf: str) -> DataFrame:
    return R6(T.segment_height(boxes(spark, sf), segments(spark, sf), ["idle"], 640), "reach")


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of supplied parts as tracks: supplier is the series, line number the track, order by sevens the frame."""
    b = table(spark, sf, "lineitem")
    frame = F.floor(F.col("l_orderkey") / 7).cast("long")
    x1, y1 = F.col("l_quantity") * 8, F.col("l_discount") * 4000
    rows = b.select(
        F.col("l_suppkey").alias("series_id"), F.col("l_linenumber").alias("track_id"), frame.alias("frame_id"), x1.alias("x1"), y1.alias("y1"), (x1 + 120).alias("x2"), (y1 + 140).alias("y2"),
        (0.3 + F.col("l_discount") * 7).alias("confidence"), F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"),
    )
    order = Window.partitionBy("series_id", "track_id", "frame_id").orderBy("k", "p", "x1")
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "k", "p")


TRACKS = """tracks AS (SELECT l_suppkey AS series_id, l_linenumber AS track_id, l_orderkey // 7 AS frame_id, l_quantity * 8 AS x1, l_discount * 4000 AS y1, l_quantity * 8 + 120 AS x2, l_discount * 4000 + 140 AS y2,
  0.3 + l_discount * 7 AS confidence FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_linenumber, l_orderkey // 7 ORDER BY l_orderkey, l_partkey, l_quantity) = 1),
pairs AS (SELECT *, lead(frame_id) OVER w AS f2, lead(x1) OVER w AS a1, lead(y1) OVER w AS b1, lead(x2) OVER w AS a2, lead(y2) OVER w AS b2, lead(confidence) OVER w AS c2
  FROM tracks WINDOW w AS (PARTITION BY series_id, track_id ORDER BY frame_id))"""


@query(
    f"""WITH {TRACKS}, i AS (SELECT *, unnest(range(frame_id + 1, f2)) AS f FROM pairs WHERE f2 - frame_id - 1 BETWEEN 1 AND 30
  AND sqrt(((a1 + a2) / 2 - (x1 + x2) / 2) ** 2 + ((b1 + b2) / 2 - (y1 + y2) / 2) ** 2) <= greatest(x2 - x1, y2 - y1) * (f2 - frame_id - 1) * 0.75)
SELECT series_id, track_id, f AS frame_id, round(x1 + (a1 - x1) * t, 6) AS x1, round(y1 + (b1 - y1) * t, 6) AS y1, round(x2 + (a2 - x2) * t, 6) AS x2, round(y2 + (b2 - y2) * t, 6) AS y2,
  round(least(confidence, c2) * 0.8, 6) AS confidence FROM (SELECT *, (f - frame_id) / (f2 - frame_id)::DOUBLE AS t FROM i)"""
)
def interpolate_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return R6(T.interpolate_tracks(tracks(spark, sf)), "x1", "y1", "x2", "y2", "confidence")


@query(f"WITH {TRACKS} SELECT series_id, track_id, frame_id AS from_frame, f2 AS to_frame FROM pairs WHERE f2 - frame_id > 30 AND f2 - frame_id <= 90")
def track_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return T.track_gaps(tracks(spark, sf), 30, 90)


@query(f"WITH {BOXES} SELECT DISTINCT series_id, class_name FROM boxes b WHERE class_name <> 'R' AND EXISTS (SELECT 1 FROM boxes a WHERE a.frame_id = b.frame_id AND a.class_name = 'R' AND a.confidence > 0.9)")
def interactor_ids(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf)
    return T.interactors(b.where("class_name <> 'R'"), b.where("class_name = 'R' and confidence > 0.9"))


def _dissimilarity_sql() -> str:
    x, y, c = (lambda e, i: f"{e}[{3 * i + 1}]"), (lambda e, i: f"{e}[{3 * i + 2}]"), (lambda e, i: f"abs({e}[{3 * i + 3}])")
    both = lambda i: f"{c('a.e', i)} >= 0.3 AND {c('b.e', i)} >= 0.3"
    n = " + ".join(f"CASE WHEN {both(i)} THEN 1 ELSE 0 END" for i in range(17))
    d = " + ".join(f"CASE WHEN {both(i)} THEN sqrt(({x('a.e', i)} - {x('b.e', i)}) ** 2 + ({y('a.e', i)} - {y('b.e', i)}) ** 2) ELSE 0 END" for i in range(17))
    return f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (
  SELECT a.vec_id, {n} AS n, {d} AS d FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(CASE WHEN n < 3 THEN 999 ELSE d / n / sqrt(4.0::DOUBLE) * 100 END, 5) AS dissimilarity FROM p"""


@query(_dissimilarity_sql())
def pose_dissimilarity(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    keypoint = lambda i: F.struct(e[3 * i].alias("x"), e[3 * i + 1].alias("y"), F.abs(e[3 * i + 2]).alias("conf"))
    rows = table(spark, sf, "embeddings").select("vec_id", F.array(*[keypoint(i) for i in range(17)]).alias("k"))
    b = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("k").alias("l"))
    return rows.join(b, "vec_id").select("vec_id", F.round(T.pose_dissimilarity(F.col("k"), F.col("l"), F.lit(4.0)), 5).alias("dissimilarity"))


@query(
    f"""WITH {BOXES} SELECT series_id, frame_id, box_id, x1, round(least(100, greatest(0, (500 - (y1 + (y2 - y1) * CASE class_name WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.5 ELSE 0.9 END)) / 480 * 100)), 6) AS distance FROM boxes"""
)
def normalized_distance(spark: SparkSession, sf: str) -> DataFrame:
    weight = F.when(F.col("class_name") == "A", 1.0).when(F.col("class_name") == "N", 0.5).otherwise(0.9)
    d = T.normalized_distance(F.lit(500.0), F.col("y1"), F.col("y2"), weight, F.lit(480.0))
    return boxes(spark, sf).select("series_id", "frame_id", "box_id", "x1", F.round(d, 6).alias("distance"))


def signal(spark: SparkSession, sf: str) -> DataFrame:
    """A signal ``(series_id, frame_id, value, cx, cy)`` from events in time order."""
    s = samples(spark, sf)
    return s.select("series_id", F.col("i").cast("long").alias("frame_id"), F.least(F.lit(100), F.floor(F.col("value") + 50)).cast("int").alias("value"), (F.col("i") % 9 * 2.0).alias("cx"), (F.col("i") % 4 * 3.0).alias("cy"))


SIGNAL = """sig AS (SELECT series_id, frame_id, CAST(least(100, floor(v)) AS INTEGER) AS value, frame_id % 9 * 2.0::DOUBLE AS cx, frame_id % 4 * 3.0::DOUBLE AS cy FROM (
  SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_id, value AS v FROM events))"""


@query(
    f"""WITH {SIGNAL} SELECT series_id, frame_id, round(least(100, greatest(0, CASE WHEN n < 3 THEN least(100, value / 200.0::DOUBLE * 100) WHEN hi > lo THEN (m - lo) / (hi - lo)::DOUBLE * 100 ELSE 50 END)), 6) AS value
FROM (SELECT *, count(value) OVER w AS n, median(value) OVER w AS m, min(value) OVER w AS lo, max(value) OVER w AS hi FROM sig WINDOW w AS (PARTITION BY series_id ORDER BY frame_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""
)
def fallback_distance(spark: SparkSession, sf: str) -> DataFrame:
    s = signal(spark, sf).withColumnRenamed("value", "d")
    return R6(T.fallback_distance(s, "d").select("series_id", "frame_id", "value"), "value")


@query(
    f"""WITH {BOXES}, f AS (SELECT series_id, frame_id, CASE WHEN sum(w) > 0 THEN sum(x1 * w) / sum(w) END AS v FROM (SELECT *, CASE WHEN class_name = 'R' THEN 0.5 WHEN class_name = 'A' THEN 0.25 ELSE 0 END AS w FROM boxes) GROUP BY ALL)
SELECT series_id, frame_id, round(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 50), 6) AS value FROM f"""
)
def weighted_distance(spark: SparkSession, sf: str) -> DataFrame:
    weight = F.when(F.col("class_name") == "R", 0.5).when(F.col("class_name") == "A", 0.25).otherwise(0.0)
    return R6(T.weighted_distance(boxes(spark, sf).select("series_id", "frame_id", F.col("x1").alias("value"), weight.alias("weight"))), "value")


@query(
    f"""WITH {SIGNAL} SELECT series_id, frame_id, cx, cy, CAST(CASE WHEN p IS NULL THEN value ELSE least(100, greatest(0, CASE WHEN abs(value - p) > 8 AND NOT m THEN p + sign(value - p) * floor(abs(value - p) * 0.6)
  WHEN m AND abs(value - p) < 5 THEN value + CASE WHEN dy > 0 THEN 8 ELSE -8 END ELSE value END)) END AS INTEGER) AS value
FROM (SELECT *, coalesce(dx * dx + dy * dy > 25, false) AS m FROM (SELECT *, lag(value) OVER w AS p, cx - lag(cx) OVER w AS dx, cy - lag(cy) OVER w AS dy FROM sig WINDOW w AS (PARTITION BY series_id ORDER BY frame_id)))"""
)
def motion_enhance(spark: SparkSession, sf: str) -> DataFrame:
    return T.motion_enhance(signal(spark, sf))


@query(
    f"""WITH {SIGNAL}, g AS (SELECT *, frame_id // 25 AS segment, CASE WHEN frame_id // 25 % 3 = 1 THEN 'idle' ELSE 'busy' END AS label FROM sig),
q AS (SELECT series_id, segment, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.95) AS p95, min(value) AS mn, max(value) AS mx FROM g GROUP BY ALL),
r AS (SELECT series_id, segment, min(value) AS lo, max(value) AS hi FROM g JOIN q USING (series_id, segment) WHERE value BETWEEN p5 AND p95 GROUP BY ALL)
SELECT series_id, frame_id, segment, label, value, CAST(least(100, greatest(0, round_even(round(CASE WHEN label = 'idle' THEN 100
  WHEN value >= p95 THEN CASE WHEN mx - p95 > 1e-6 THEN 95 + (value - p95) / (mx - p95) * 5 ELSE 100 END WHEN value <= p5 THEN CASE WHEN p5 - mn > 1e-6 THEN (value - mn) / (p5 - mn) * 5 ELSE 0 END
  WHEN coalesce(hi, mx) - coalesce(lo, mn) < 1e-6 THEN 50 ELSE 5 + (value - coalesce(lo, mn)) / (coalesce(hi, mx) - coalesce(lo, mn))::DOUBLE * 90 END, 9), 0))) AS INTEGER) AS out
FROM g JOIN q USING (series_id, segment) LEFT JOIN r USING (series_id, segment)"""
)
def segment_normalize(spark: SparkSession, sf: str) -> DataFrame:
    s = signal(spark, sf).withColumn("segment", F.floor(F.col("frame_id") / 25).cast("long"))
    s = s.withColumn("label", F.when(F.col("segment") % 3 == 1, "idle").otherwise("busy"))
    return T.segment_normalize(s, ["idle"]).select("series_id", "frame_id", "segment", "label", "value", "out")


@query(
    """WITH f AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_id, event_type AS class_name FROM events)
SELECT series_id, frame_id, class_name, CASE WHEN c >= 3 THEN 'click' WHEN v >= 3 THEN 'view' WHEN e >= 3 THEN 'error' END AS stable FROM (
  SELECT *, count(*) FILTER (WHERE class_name = 'click') OVER w AS c, count(*) FILTER (WHERE class_name = 'view') OVER w AS v, count(*) FILTER (WHERE class_name = 'error') OVER w AS e
  FROM f WINDOW w AS (PARTITION BY series_id ORDER BY frame_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""
)
def stable_class(spark: SparkSession, sf: str) -> DataFrame:
    from kinetra.plans.q_editing import frames

    return T.stable_class(frames(spark, sf).withColumnRenamed("label", "class_name"), {"view": 2, "click": 3, "error": 1})


@query(
    f"""WITH {SIGNAL}, runs AS (SELECT series_id, run, min(frame_id) AS start_frame, max(frame_id) AS end_frame, count(*) AS frames FROM (
  SELECT *, sum(CASE WHEN b IS NULL OR b <> label THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY frame_id) AS run FROM (
    SELECT *, lag(label) OVER (PARTITION BY series_id ORDER BY frame_id) AS b FROM (SELECT *, CASE WHEN value < 40 THEN 'made' ELSE 'seen' END AS label FROM sig))) WHERE label = 'made' GROUP BY series_id, run)
SELECT series_id, start_frame, end_frame, frames FROM runs"""
)
def occlusion_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = signal(spark, sf).withColumn("label", F.when(F.col("value") < 40, "made").otherwise("seen"))
    return E.label_runs(rows).where("label = 'made'").drop("label")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Motion of grid cells from ``lineitem``: ship day by weeks is the frame, quantity and tax the cell."""
    b = table(spark, sf, "lineitem")
    day = F.datediff(F.col("l_shipdate"), F.lit("1992-01-01"))
    return b.select(
        (F.col("l_suppkey") % 5).alias("series_id"), F.floor(day / 7).cast("long").alias("frame_id"), F.floor(F.col("l_quantity") / 13).cast("int").alias("row"), F.floor(F.round(F.col("l_tax") * 100) / 2).cast("int").alias("col"),
        (F.col("l_discount") * 100 - 5).alias("d"), (F.col("l_linenumber") - 3).alias("e"),
    ).groupBy("series_id", "frame_id", "row", "col").agg(F.round(F.avg("d"), 6).alias("dy"), F.round(F.avg("e"), 6).alias("dx"), (F.max("e") >= 4).alias("hit"))


@query(
    """WITH c AS (SELECT l_suppkey % 5 AS series_id, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) // 7 AS frame_id, CAST(floor(l_quantity / 13) AS INTEGER) AS row_, CAST(floor(round(l_tax * 100) / 2) AS INTEGER) AS col_,
  round(avg(l_discount * 100 - 5), 6) AS dy, round(avg(l_linenumber - 3), 6) AS dx, max(l_linenumber - 3) >= 4 AS hit FROM lineitem GROUP BY ALL),
v AS (SELECT * EXCLUDE (dx, dy), dy - median(dy) OVER (PARTITION BY series_id, frame_id) AS v, dx - median(dx) OVER (PARTITION BY series_id, frame_id) AS u FROM c),
-- active: a hit of the cell within the last frames, as an equality of sets of frames rather than a running maximum
a AS (SELECT v.*, row_number() OVER (PARTITION BY series_id, row_, col_ ORDER BY frame_id) AS k, sqrt(u * u + v * v) AS mag FROM v
  WHERE EXISTS (SELECT 1 FROM c WHERE c.hit AND c.series_id = v.series_id AND c.row_ = v.row_ AND c.col_ = v.col_ AND c.frame_id BETWEEN v.frame_id - 6 AND v.frame_id)),
-- the history of each active row as lists, oldest first
h AS (SELECT *, list(v) OVER w AS vs, list(mag) OVER w AS ms FROM a WINDOW w AS (PARTITION BY series_id, row_, col_ ORDER BY k ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
g AS (SELECT *, list_transform(range(1, len(vs) - 3), lambda i: sign(round(vs[i] + vs[i + 1] + vs[i + 2] + vs[i + 3] + vs[i + 4], 9))) AS five, list_transform(vs, lambda x: sign(round(x, 9))) AS one FROM h WHERE len(vs) > 10 AND mag > 0.2),
f AS (SELECT *, len(list_filter(range(2, len(five) + 1), lambda i: five[i] <> five[i - 1])) / 2 / 2.0::DOUBLE AS hz, len(list_filter(range(2, len(one) + 1), lambda i: one[i] <> one[i - 1])) AS turns FROM g),
s AS (SELECT *, list_avg(ms) * (0.7 * (1 + 10 * turns / len(vs)) * (1 + list_stddev_pop(vs)) + 0.3 * hz * exp(-((hz - 2.5) * (hz - 2.5)) / 4.5)) AS s FROM f WHERE hz BETWEEN 0.5 AND 7),
n AS (SELECT s.*, s * (1 + 0.2 * (SELECT count(*) FROM s o WHERE o.series_id = s.series_id AND o.frame_id = s.frame_id AND o.s > 0.5 AND abs(o.row_ - s.row_) <= 1 AND abs(o.col_ - s.col_) <= 1 AND (o.row_ <> s.row_ OR o.col_ <> s.col_))) AS score FROM s WHERE s > 0.5)
SELECT series_id, frame_id, count(*) AS cells, round(CASE WHEN count(*) <= 2 THEN arg_max(v, (mag, -row_, -col_)) ELSE sum(v * score) / sum(score) END, 4) AS motion,
  round(CASE WHEN count(*) <= 2 THEN arg_max(u, (mag, -row_, -col_)) ELSE sum(u * score) / sum(score) END, 4) AS dx
FROM (SELECT *, max(score) OVER (PARTITION BY series_id, frame_id) AS b FROM n) WHERE score > 0.6 * b GROUP BY ALL"""
)
def oscillation_cells(spark: SparkSession, sf: str) -> DataFrame:
    out = T.oscillation_cells(cells(spark, sf), persist=8, history=24)
    return out.withColumns({c: F.round(c, 4) for c in ("dx", "motion")})


@query()
def track_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of wide frames, so that tracks are lost, found again and exclude each other."""
    gates = Gates(iou=0.1, exclusive=frozenset("RA"), sizes=(0.3, 3.0), jump=3.0, patience=4, memory=25, reid=2.0, closed=3)
    return track_boxes_of(boxes(spark, sf).withColumn("frame_id", F.floor(F.col("frame_id") / 100).cast("long")), gates)


def _anchors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frames with a pose that is steady now and then, boxes with tracks, and the anchors among them."""
    b = boxes(spark, sf).withColumn("frame_id", F.floor(F.col("frame_id") / 200).cast("long"))
    b = b.withColumn("box_id", F.row_number().over(Window.partitionBy("series_id", "frame_id").orderBy("box_id", "x1", "confidence")).cast("long"))
    b = b.withColumn("track_id", (F.floor(F.col("x1") / 150) * 10 + F.ascii("class_name") % 10).cast("long"))
    frames = b.select("series_id", "frame_id").distinct().withColumn("steady", F.col("frame_id") % 3 == 0)
    best = F.row_number().over(Window.partitionBy("series_id", "frame_id").orderBy(F.desc("confidence"), "box_id")) == 1
    return frames, b, b.where("class_name = 'R'").withColumn("preferred", best)


@query()
def anchor_lock(spark: SparkSession, sf: str) -> DataFrame:
    frames, _, anchors = _anchors(spark, sf)
    return R6(anchor_lock_of(frames, anchors, fps=10), "x1", "y1", "x2", "y2")


@query()
def contact_lock(spark: SparkSession, sf: str) -> DataFrame:
    frames, b, anchors = _anchors(spark, sf)
    locked = anchor_lock_of(frames, anchors, fps=10).withColumns({"y1": F.col("y2") - 200, "reach": F.lit(200.0), "person": F.array(*map(F.lit, (0.0, 0.0, 640.0, 480.0)))})
    touching = b.where("class_name <> 'R'").withColumn("contact", F.col("confidence") > 0.4)
    rules = Rules(primary=("N",), fallback=("A",), height={"N": 0.9}, weight={"A": 0.8}, patience=4, fallback_patience=3, contact=0.001)
    return contact_lock_of(locked, touching, rules).select("series_id", "frame_id", "track_id", "is_occluded", "contributors", "value")


def moving(spark: SparkSession, sf: str) -> DataFrame:
    """A signal with the motion of its frames, made of the points."""
    seq = F.col("seq")
    return points(spark, sf).select("series_id", F.col("at").alias("frame_id"), F.col("pos").alias("value"), (seq * 7 % 60).cast("double").alias("motion"), (seq % 5 - 2).cast("double").alias("dy"))


@query()
def signal_gate(spark: SparkSession, sf: str) -> DataFrame:
    return T.signal_gate(moving(spark, sf))
