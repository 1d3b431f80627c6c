"""Queries of derived axes, labels and chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.operators import compound as C
from kinetra.operators import derived as D
from kinetra.plans.base import on_points, points, query
from kinetra.plans.q_editing import FRAMES, frame_chapters, frames, on_fc
from kinetra.plans.q_joins import BOXES, boxes, samples
from kinetra.plans.q_streaming import _shared
from kinetra.streaming import jobs


def _axis(name: str) -> None:
    @query(name=f"axis_generate_{name}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return D.axis_generate(points(spark, sf), name, phase_ms=200)


for _name in ("roll", "pitch", "sway", "surge", "twist"):
    _axis(_name)


@query()
def axis_from_pose(spark: SparkSession, sf: str) -> DataFrame:
    return D.axis_from_pose(points(spark, sf), "roll", 1.2, 2)


@query()
def repeat_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return D.repeat_pattern(points(spark, sf), 30000)


@query()
def onset_flux(spark: SparkSession, sf: str) -> DataFrame:
    return D.onset_flux(samples(spark, sf), 10, 8, 2, 0.5, 0.4)


@query(
    f"""WITH {BOXES}, s AS (SELECT *, CASE class_name WHEN 'A' THEN 1 WHEN 'N' THEN 3 WHEN 'R' THEN 2 END AS p, (x2 - x1) * (y2 - y1) AS area FROM boxes)
SELECT series_id, frame_id, CASE WHEN c IS NULL THEN 'none' WHEN c = 'A' THEN 'one' WHEN c = 'N' THEN 'three' ELSE 'two' END AS label FROM (
  SELECT series_id, frame_id, arg_max(class_name, (class_name = 'R', CASE WHEN class_name = 'R' THEN p ELSE p * (1 + area / (480.0 * 480) * 100) END, area, class_name)) AS c FROM s GROUP BY series_id, frame_id)"""
)
def label_weak(spark: SparkSession, sf: str) -> DataFrame:
    return D.label_weak(boxes(spark, sf), {"A": (1, "one"), "N": (3, "three"), "R": (2, "two")}, ("R",), 480, "none")


@query(
    f"""WITH {FRAMES}, r AS (SELECT *, last_value(CASE WHEN frame_id % 3 = 0 THEN frame_id % 11 END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY frame_id) AS p FROM frames),
g AS (SELECT *, last_value(CASE WHEN label <> 'view' THEN label END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY frame_id) AS good,
  max(CASE WHEN label <> 'view' THEN frame_id END) OVER (PARTITION BY series_id ORDER BY frame_id) AS seen FROM r)
SELECT g.series_id, g.frame_id, CASE WHEN g.label = 'view' AND g.good IN ('click', 'error') AND abs(g.p - a.p) * 50 < 120 THEN g.good ELSE g.label END AS label
FROM g LEFT JOIN r a ON a.series_id = g.series_id AND a.frame_id = g.seen"""
)
def label_persistence(spark: SparkSession, sf: str) -> DataFrame:
    """Every third frame has a pose of four keypoints, moved as a whole; two labels have zones."""
    f = frames(spark, sf)
    keypoint = lambda i: F.struct((F.col("frame_id") % 11 + i).cast("double").alias("x"), F.lit(2.0 * i).alias("y"), F.lit(1.0).alias("conf"))
    pose = F.when(F.col("frame_id") % 3 == 0, F.array(*[keypoint(i) for i in range(4)]))
    posed = f.withColumns({"pose": pose, "area": F.lit(4.0)})
    return D.label_persistence(posed, "view", {"click": [0, 1, 3], "error": [0, 1, 2, 3]}, 120).drop("pose", "area")


@query()
def chapters_build(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    return D.chapters_build(f, ["click", "error", "purchase", "signup", "view"], ["view"], 0.2, 7, f.where("label = 'click'"), 2)


@query(
    on_fc("""SELECT series_id, chapter_id, label, start_frame, end_frame FROM fc WHERE NOT (chapter_id IN (series_id || '-0', series_id || '-1') AND series_id NOT IN (SELECT a.series_id FROM fc a JOIN fc b ON a.series_id = b.series_id
  AND a.chapter_id = a.series_id || '-1' AND b.chapter_id NOT IN (b.series_id || '-0', b.series_id || '-1') AND b.start_frame <= greatest(a.end_frame, (SELECT z.end_frame FROM fc z WHERE z.chapter_id = a.series_id || '-0'))))
UNION ALL SELECT a.series_id, a.chapter_id, a.label, a.start_frame, greatest(a.end_frame, b.end_frame) FROM fc a JOIN fc b ON a.series_id = b.series_id AND a.chapter_id = a.series_id || '-0' AND b.chapter_id = b.series_id || '-1'
WHERE NOT EXISTS (SELECT 1 FROM fc o WHERE o.series_id = a.series_id AND o.chapter_id NOT IN (a.chapter_id, b.chapter_id) AND o.start_frame <= greatest(a.end_frame, b.end_frame) AND o.end_frame >= a.start_frame)""")
)
def chapter_merge2(spark: SparkSession, sf: str) -> DataFrame:
    c = frame_chapters(spark, sf)
    pairs = c.select("series_id").distinct().select("series_id", F.concat_ws("-", "series_id", F.lit(0)).alias("first_id"), F.concat_ws("-", "series_id", F.lit(1)).alias("second_id"))
    return D.chapters_join(c, pairs)


@query(
    on_fc("""SELECT c.series_id, c.chapter_id, c.label, c.start_frame, c.end_frame FROM fc c WHERE NOT EXISTS (
  SELECT 1 FROM fc a JOIN fc b ON a.series_id = b.series_id AND a.chapter_id = a.series_id || '-0' AND b.chapter_id = b.series_id || '-3'
  WHERE a.series_id = c.series_id AND (c.chapter_id IN (a.chapter_id, b.chapter_id) OR (c.start_frame >= least(a.start_frame, b.start_frame) AND c.end_frame <= CASE WHEN a.start_frame > b.start_frame THEN a.end_frame ELSE b.end_frame END)))
UNION ALL SELECT a.series_id, CASE WHEN a.start_frame > b.start_frame THEN b.chapter_id ELSE a.chapter_id END, CASE WHEN a.start_frame > b.start_frame THEN b.label ELSE a.label END,
  least(a.start_frame, b.start_frame), CASE WHEN a.start_frame > b.start_frame THEN a.end_frame ELSE b.end_frame END
FROM fc a JOIN fc b ON a.series_id = b.series_id AND a.chapter_id = a.series_id || '-0' AND b.chapter_id = b.series_id || '-3'""")
)
def chapter_consume(spark: SparkSession, sf: str) -> DataFrame:
    c = frame_chapters(spark, sf)
    pairs = c.select("series_id").distinct().select("series_id", F.concat_ws("-", "series_id", F.lit(3)).alias("first_id"), F.concat_ws("-", "series_id", F.lit(0)).alias("second_id"))
    return D.chapters_consume(c, pairs)


@query(on_points("SELECT series_id, axis, at // 500 * 500 AS at, arg_min(pos, seq) AS pos, min(seq) AS seq FROM points GROUP BY ALL"))
def first_of_times(spark: SparkSession, sf: str) -> DataFrame:
    return D.first_of_times(points(spark, sf).withColumn("at", (F.floor(F.col("at") / 500) * 500).cast("long")))


@query(on_points("SELECT series_id, axis, at, pos, seq FROM (SELECT *, max(at) OVER (PARTITION BY series_id, axis) AS z FROM points) WHERE at >= z - 8000"))
def last_window(spark: SparkSession, sf: str) -> DataFrame:
    return D.last_window(points(spark, sf), 8000)


def rolling_parts(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Points of three stretches of time, the last with some that come late."""
    p = points(spark, sf)
    late = F.col("seq") % 50 == 0
    return [p.where((F.col("at") < 25_000) & ~late), p.where(F.col("at").between(25_000, 49_999) & ~late), p.where((F.col("at") >= 50_000) | late)]


@query()
def stream_rolling_filter(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of point files in three arrivals; after each the last 20 s of the touched series are tuned again.

    An arrival is as many files as its tasks write, and one micro-batch: the stream goes on from its checkpoint.
    """
    base = _shared(spark)
    parts = rolling_parts(spark, sf)
    step = jobs.rolling_filter(f"{base}/out", C.ultimate_autotune, 20_000)
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        rows = spark.readStream.schema(parts[0].schema).parquet(f"{base}/in")
        rows.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
    return jobs.latest(spark, f"{base}/out", parts[0]).select("series_id", "axis", "at", "pos")
