"""Queries of the file formats: documents are built from the tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.plans.base import AXES_SQL, on_points, points, query, table
from kinetra.plans.q_joins import chapters, with_chapters
from kinetra.plans.q_streaming import _shared as shared_folder
from kinetra.sources import scripts as R

S = "(PARTITION BY series_id, axis ORDER BY at, seq)"


@query(on_points("SELECT series_id, axis, at, pos FROM points"))
def read_scripts(spark: SparkSession, sf: str) -> DataFrame:
    docs = R.single_documents(points(spark, sf)).select("series_id", "value")
    return R.read_scripts(R.parse(docs), ["series_id"]).select("series_id", "axis", "at", "pos")


@query("""SELECT event_id AS series_id, CAST(trunc(value) AS BIGINT) AS at, CAST(least(100, greatest(0, event_id % 300 - 50)) AS INTEGER) AS pos FROM events WHERE event_id % 3 < 2""")
def read_scripts_lenient(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers as text and fractions, positions out of range, points without a position, and texts that are no JSON."""
    e = table(spark, sf, "events")
    pos = F.concat(F.lit('"'), (F.col("event_id") % 300 - 50).cast("string"), F.lit('"'))
    text = F.concat(F.lit('{"actions": [{"at": '), F.col("value").cast("string"), F.lit(', "pos": '), pos, F.lit('}, {"at": 7}, {"pos": 3}, {"at": "x", "pos": 1}]}'))
    docs = e.select(F.col("event_id").alias("series_id"), F.when(F.col("event_id") % 3 < 2, text).otherwise(F.lit("no json {")).alias("value"))
    return R.read_scripts(R.parse(docs), ["series_id"]).select("series_id", "at", "pos")


@query(f"WITH {AXES_SQL}\nSELECT series_id, axis, at, pos FROM points WHERE axis <> 'click'")
def read_embedded_axes(spark: SparkSession, sf: str) -> DataFrame:
    docs = R.unified_documents(points(spark, sf, None), primary="click")
    return R.read_embedded_axes(R.parse(docs), ["series_id"]).select("series_id", "axis", "at", "pos")


@query(f"""WITH {AXES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id, axis ORDER BY at, seq, pos) - 1 AS i FROM points),
n AS (SELECT series_id, axis, row_number() OVER (PARTITION BY series_id ORDER BY axis) - 1 AS place FROM (SELECT DISTINCT series_id, axis FROM points WHERE axis <> 'click'))
SELECT r.series_id, coalesce(n.place, -1) AS place, CASE WHEN r.axis = 'click' THEN '' ELSE r.axis || ' ' || r.axis END AS name, CAST(r.i AS INTEGER) AS i, r.at, r.pos
FROM r LEFT JOIN n ON r.series_id = n.series_id AND r.axis = n.axis""")
def write_scripts_unified(spark: SparkSession, sf: str) -> DataFrame:
    """All points of the documents with their places: those at the root, and those of each axis with its codes and name."""
    text = R.unified_documents(points(spark, sf, None), primary="click")
    kind = "actions ARRAY<STRUCT<at: BIGINT, pos: INT>>"
    doc = text.select("series_id", F.from_json("value", f"{kind}, axes ARRAY<STRUCT<axes: ARRAY<STRING>, name: STRING, {kind.replace(' ', ': ', 1)}>>").alias("d"))
    axes = doc.select("series_id", F.posexplode("d.axes").alias("place", "x"))
    axes = axes.select("series_id", F.col("place").cast("long").alias("place"), F.concat_ws(" ", "x.axes", "x.name").alias("name"), F.col("x.actions").alias("actions"))
    root = doc.select("series_id", F.lit(-1).cast("long").alias("place"), F.lit("").alias("name"), F.col("d.actions").alias("actions"))
    rows = root.unionByName(axes).select("series_id", "place", "name", F.posexplode("actions").alias("i", "p"))
    return rows.select("series_id", "place", "name", "i", "p.at", "p.pos")


@query(
    on_points("""SELECT series_id, axis, at, CAST(least(100, greatest(0, CASE WHEN max(p) OVER (PARTITION BY series_id, axis) > 100 THEN round_even(p * 100 / 9999.0::DOUBLE, 0) ELSE p END)) AS INTEGER) AS pos, seq
FROM (SELECT *, CASE WHEN series_id % 2 = 0 THEN pos * 99 ELSE pos END AS p FROM points)""")
)
def rescale_device_range(spark: SparkSession, sf: str) -> DataFrame:
    return R.rescale_device_range(points(spark, sf).withColumn("pos", F.when(F.col("series_id") % 2 == 0, F.col("pos") * 99).otherwise(F.col("pos"))))


@query(
    with_chapters("""SELECT series_id, CAST(ord AS INTEGER) AS ord, label, CAST(round_even(start_ms * 30.0::DOUBLE / 1000, 0) AS BIGINT) AS start_frame, CAST(round_even(end_ms * 30.0::DOUBLE / 1000, 0) AS BIGINT) - 1 AS end_frame FROM chapters""")
)
def read_script_chapters(spark: SparkSession, sf: str) -> DataFrame:
    code = lambda c: F.format_string("00:%02d:%02d.%03d", F.floor(F.col(c) / 60000), F.floor(F.col(c) / 1000) % 60, F.col(c) % 1000)
    ch = chapters(spark, sf).select("series_id", code("start_ms").alias("startTime"), code("end_ms").alias("endTime"), F.col("label").alias("name"))
    broken = ch.groupBy("series_id").agg(F.lit("99:99").alias("startTime"), F.max("endTime").alias("endTime"), F.lit("broken").alias("name"))
    docs = R.unified_documents(points(spark, sf), ch.unionByName(broken))
    return R.read_script_chapters(R.parse(docs), ["series_id"])


@query("""SELECT 'v' || p_partkey // 3 AS base, CASE WHEN p_partkey % 3 = 0 THEN 'stroke' WHEN p_partkey % 3 = 1 THEN 'roll' ELSE 'axis_7' END AS axis,
  CASE p_partkey % 3 WHEN 0 THEN '/x/v' || p_partkey // 3 || '.script' WHEN 1 THEN '/x/v' || p_partkey // 3 || '.roll.script' ELSE '/x/v' || p_partkey // 3 || '_t7.script' END AS path FROM part""")
def discover_axis_files(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    base, kind = F.concat(F.lit("/x/v"), F.floor(F.col("p_partkey") / 3).cast("string")), F.col("p_partkey") % 3
    main = F.when(kind == 0, F.concat(base, F.lit(".script"))).when(kind == 1, F.concat(base, F.lit(".roll.script"))).otherwise(F.concat(base, F.lit("_t7.script")))
    files = p.select(main.alias("path")).unionByName(p.where(kind == 1).select(F.concat(base, F.lit("_t2.script")).alias("path"))).unionByName(p.where(kind == 0).select(F.concat(base, F.lit(".mp4")).alias("path")))
    return R.discover_axis_files(files)


@query(f"WITH {AXES_SQL}\nSELECT series_id, axis, at, pos, row_number() OVER {S} - 1 AS seq FROM points")
def project_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return R.from_projects(R.to_projects(points(spark, sf, None)))


@query(on_points("""SELECT 'p' || series_id AS name, count(*) AS n, max(at) - min(at) AS duration_ms, list(struct_pack(at := at - a, pos := pos) ORDER BY at, seq) AS actions
FROM (SELECT *, min(at) OVER (PARTITION BY series_id) AS a FROM points WHERE pos > 60) GROUP BY series_id HAVING count(*) >= 2"""))
def patterns_io(spark: SparkSession, sf: str) -> DataFrame:
    rows = points(spark, sf).where("pos > 60").select(F.concat(F.lit("p"), F.col("series_id").cast("string")).alias("name"), "at", "pos", "seq")
    return R.patterns(rows)


@query(on_points("""SELECT 'p' || series_id AS name, max(at) - min(at) AS duration_ms, list(struct_pack(at := at - a, pos := pos) ORDER BY at, seq) AS actions
FROM (SELECT *, min(at) OVER (PARTITION BY series_id) AS a FROM points WHERE pos > 60 AND series_id % 3 = 0) GROUP BY series_id HAVING count(*) >= 2"""))
def patterns_load(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns written as documents and read back, beside documents that hold none."""
    rows = points(spark, sf).where("pos > 60 and series_id % 3 = 0").select(F.concat(F.lit("p"), F.col("series_id").cast("string")).alias("name"), "at", "pos", "seq")
    broken = table(spark, sf, "region").select(F.lit("broken").alias("name"), F.concat(F.lit('{"name": '), F.col("r_name")).alias("value"))
    return R.load_patterns(R.pattern_documents(R.patterns(rows)).unionByName(broken))


@query(with_chapters("""SELECT series_id, chapter_id AS unique_id, CAST(round_even(start_ms * 30.0::DOUBLE / 1000, 0) AS BIGINT) AS start_frame_id, CAST(round_even(end_ms * 30.0::DOUBLE / 1000, 0) AS BIGINT) AS end_frame_id, label AS class_name,
  label AS position_long_name, 'manual' AS source, 30.0::DOUBLE AS video_fps FROM chapters"""))
def chapters_json_io(spark: SparkSession, sf: str) -> DataFrame:
    """Chapters written to files that count frames, and read back."""
    back = R.parse_chapters(R.chapter_documents(R.chapter_rows(chapters(spark, sf), 30.0)))
    return back.select("series_id", "unique_id", "start_frame_id", "end_frame_id", "class_name", "position_long_name", "source", "video_fps")


ACTIONS = "list(struct_pack(at := at, pos := pos) ORDER BY at, seq) AS actions"


def _actions(parsed: DataFrame) -> DataFrame:
    """The actions as they were read, as whole numbers."""
    number = F.transform("script.actions", lambda p: F.struct(p["at"].cast("double").cast("long").alias("at"), p["pos"].cast("double").cast("int").alias("pos")))
    return parsed.withColumn("actions", number).drop("script")


@query(on_points(f"SELECT series_id, axis, {ACTIONS} FROM points GROUP BY ALL"))
def write_scripts_single(spark: SparkSession, sf: str) -> DataFrame:
    return _actions(R.parse(R.single_documents(points(spark, sf)))).select("series_id", "axis", "actions")


@query(f"WITH {AXES_SQL}\nSELECT axis, {ACTIONS} FROM points GROUP BY series_id, axis")
def write_scripts_per_axis(spark: SparkSession, sf: str) -> DataFrame:
    """Files in a folder for each axis, read back."""
    path = shared_folder(spark)
    R.write_documents(R.single_documents(points(spark, sf, None)), path, per_axis=True)
    return _actions(R.parse(spark.read.text(path))).select("axis", "actions")
