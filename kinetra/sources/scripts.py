"""Script, project, chapter and pattern files as tables and back.

Files are JSON documents, one for each series. A malformed value drops its point or chapter, never the job.
Writers build one document for each series (or series and axis), so a document is as large as its series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetra.functions.numbers import axis_code, axis_of_code, axis_of_suffix, ms_to_frame
from kinetra.schema import KEY, clip, rint

_ACTIONS = "ARRAY<STRUCT<at: STRING, pos: STRING>>"
SCRIPT = f"""version STRING, author STRING, actions {_ACTIONS}, metadata STRUCT<chapters_fps: DOUBLE,
  chapters: ARRAY<STRUCT<name: STRING, startTime: STRING, endTime: STRING>>>, axes ARRAY<STRUCT<axes: ARRAY<STRING>, name: STRING, actions: {_ACTIONS}>>"""
DEVICE_SCALE = 9999


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(path, value)``: every file as one text."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def parse(documents: DataFrame) -> DataFrame:
    """``documents(..., value)`` with the parsed column ``script``; null where the text is no JSON object."""
    return documents.withColumn("script", F.from_json("value", SCRIPT, {"mode": "PERMISSIVE"})).drop("value")


def _points(rows: DataFrame, key: list[str], axis: Column, actions: Column) -> DataFrame:
    """Exploded actions that have both numbers, truncated, limited to 0 to 100 and time 0."""
    got = rows.select(*key, axis.alias("axis"), F.posexplode(actions).alias("seq", "a"))
    number = lambda c: F.col(c).try_cast("double").cast("long")
    got = got.select(*key, "axis", number("a.at").alias("at"), number("a.pos").alias("pos"), F.col("seq").cast("long").alias("seq"))
    return got.where("at is not null and pos is not null and at >= 0")


def read_scripts(parsed: DataFrame, key: list[str]) -> DataFrame:
    """Points of the root actions: ``(key..., axis, at, pos, seq)`` on the primary axis."""
    return _points(parsed, key, F.lit("stroke"), F.col("script.actions")).withColumn("pos", clip(F.col("pos")).cast("int"))


def read_embedded_axes(parsed: DataFrame, key: list[str]) -> DataFrame:
    """Points of ``axes``: the axis by device code, else by name, else the code itself, else ``unknown``; on 0 to 100."""
    rows = parsed.select(*key, F.explode("script.axes").alias("x"))
    code, name = F.try_element_at(F.col("x.axes"), F.lit(1)), F.nullif(F.lower("x.name"), F.lit(""))
    axis = F.coalesce(axis_of_code(code), name, code, F.lit("unknown"))
    points = _points(rows, key, axis, F.col("x.actions"))
    return rescale_device_range(points, (*key, "axis"))


def rescale_device_range(points: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Axes with positions over 100 are on the device's scale of 9,999; then all are limited to 0 to 100."""
    most = F.max("pos").over(Window.partitionBy(*key))
    pos = F.when(most > 100, rint(F.col("pos") * 100 / DEVICE_SCALE)).otherwise(F.col("pos"))
    return points.withColumn("pos", clip(pos).cast("int"))


def timecode_ms(text: Column) -> Column:
    """ms of ``HH:MM:SS[.mmm]``, or null."""
    part = lambda i: F.regexp_extract(text, r"^([0-9]+):([0-9]+):([0-9]+)(?:\.([0-9]+))?$", i).try_cast("long")
    return (part(1) * 3600 + part(2) * 60 + part(3)) * 1000 + F.coalesce(part(4), F.lit(0))


def read_script_chapters(parsed: DataFrame, key: list[str], fps: float = 30.0) -> DataFrame:
    """Chapters of the metadata that have a name and both times: frames, the end inclusive."""
    rows = parsed.select(*key, F.coalesce("script.metadata.chapters_fps", F.lit(fps)).alias("fps"), F.posexplode("script.metadata.chapters").alias("ord", "c"))
    frame = lambda c: rint(timecode_ms(F.col(c)) * F.col("fps") / 1000)
    rows = rows.select(*key, "ord", F.col("c.name").alias("label"), frame("c.startTime").alias("start_frame"), (frame("c.endTime") - 1).alias("end_frame"))
    return rows.where("label is not null and start_frame is not null and end_frame is not null")


def discover_axis_files(files: DataFrame, extension: str = ".script") -> DataFrame:
    """``files(path)`` as ``(base, axis, path)``: by the suffix before the extension; a suffix name beats the old ``_tN``.

    ``_t1`` is the primary axis, ``_t2`` roll, others ``axis_N``; without a suffix it is the primary axis.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    stem = F.when(name.endswith(extension), F.substring(name, F.lit(1), F.length(name) - len(extension)))
    rows = files.select("path", stem.alias("stem")).where("stem is not null")
    suffix, old = F.regexp_extract("stem", r"(\.[a-z]+)$", 1), F.regexp_extract("stem", r"_t([0-9]+)$", 1)
    known = axis_of_suffix(suffix)
    legacy = F.when(old == "1", "stroke").when(old == "2", "roll").when(old != "", F.concat(F.lit("axis_"), old))
    cut = F.when(known.isNotNull(), F.length(suffix)).when(legacy.isNotNull(), F.length(old) + 2).otherwise(F.lit(0))
    rows = rows.select(F.expr("stem").alias("stem"), "path", F.substring("stem", F.lit(1), F.length("stem") - cut).alias("base"), F.coalesce(known, legacy, F.lit("stroke")).alias("axis"), legacy.isNotNull().cast("int").alias("old"))
    return rows.groupBy("base", "axis").agg(F.min_by("path", F.struct("old", "path")).alias("path"))


def actions(at: str = "at", pos: str = "pos", seq: str = "seq") -> Column:
    """Sorted array of a group's points as ``{at, pos}``."""
    return F.transform(F.array_sort(F.collect_list(F.struct(at, seq, pos))), lambda p: F.struct(p[at].alias("at"), p[pos].alias("pos")))


def single_documents(points: DataFrame, author: str = "") -> DataFrame:
    """One JSON text for each series and axis."""
    rows = points.groupBy("series_id", "axis").agg(actions().alias("actions"))
    doc = F.struct(F.lit("1.0").alias("version"), F.lit(author).alias("author"), F.lit(False).alias("inverted"), F.lit(100).alias("range"), "actions")
    return rows.select("series_id", "axis", F.to_json(doc).alias("value"))


def unified_documents(points: DataFrame, chapters: DataFrame | None = None, primary: str = "stroke", author: str = "") -> DataFrame:
    """One JSON text for each series: the primary axis at the root, the others in ``axes`` with their codes."""
    rows = points.groupBy("series_id", "axis").agg(actions().alias("actions"))
    axis = F.struct(F.array(F.coalesce(axis_code(F.col("axis")), F.col("axis"))).alias("axes"), F.col("axis").alias("name"), "actions")
    doc = rows.groupBy("series_id").agg(
        F.coalesce(F.max(F.when(F.col("axis") == primary, F.col("actions"))), F.from_json(F.lit("[]"), "ARRAY<STRUCT<at: BIGINT, pos: INT>>")).alias("actions"),
        F.array_sort(F.collect_list(F.when(F.col("axis") != primary, axis))).alias("axes"),
    )
    fields = [F.lit("1.1").alias("version"), F.lit(author).alias("author"), F.lit(100).alias("range"), F.col("actions"), F.col("axes")]
    if chapters is not None:
        listed = chapters.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("startTime", "endTime", "name"))).alias("chapters"))
        doc = doc.join(listed, "series_id", "left")
        fields.append(F.struct("chapters").alias("metadata"))
    return doc.select("series_id", F.to_json(F.struct(*fields)).alias("value"))


def write_documents(documents: DataFrame, path: str, per_axis: bool = False) -> None:
    """Documents as lines of text, a folder for each axis if ``per_axis``."""
    out = documents.select("axis", "value") if per_axis else documents.select("value")
    (out.write.partitionBy("axis") if per_axis else out.write).mode("overwrite").text(path)


def to_projects(points: DataFrame) -> DataFrame:
    """Nested projects: ``(series_id, axes map<axis, actions>)``."""
    rows = points.groupBy("series_id", "axis").agg(actions().alias("actions"))
    return rows.groupBy("series_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("axis", "actions")))).alias("axes"))


def from_projects(projects: DataFrame) -> DataFrame:
    rows = projects.select("series_id", F.explode("axes").alias("axis", "actions")).select("series_id", "axis", F.posexplode("actions").alias("seq", "p"))
    return rows.select("series_id", "axis", F.col("p.at").alias("at"), F.col("p.pos").alias("pos"), F.col("seq").cast("long").alias("seq"))


def patterns(points: DataFrame) -> DataFrame:
    """Named patterns from points ``(name, at, pos, seq)``: shifted to time 0, two points at least, with their duration."""
    rows = points.groupBy("name").agg(F.min("at").alias("_a"), (F.max("at") - F.min("at")).alias("duration_ms"), F.count("*").alias("n"), actions().alias("actions")).where("n >= 2")
    moved = F.transform("actions", lambda p: F.struct((p["at"] - F.col("_a")).alias("at"), p["pos"].alias("pos")))
    return rows.select("name", "n", "duration_ms", moved.alias("actions"))


#: Fixed values of the chapter file: its version and the fields of a chapter that are read and written.
CHAPTER_VERSION = "1.0"
CHAPTER_FIELDS = "start_frame_id bigint, end_frame_id bigint, class_name string, segment_type string, position_short_name string, position_long_name string, source string, unique_id string"
CHAPTER_FILE = (
    "version string, video_filename string, video_fps double, video_total_frames bigint, created_timestamp string, source string, chapter_count int,"
    f" chapters array<struct<{CHAPTER_FIELDS.replace(' bigint', ': bigint').replace(' string', ': string')}>>"
)


def chapter_rows(chapters: DataFrame, fps: float) -> DataFrame:
    """Chapters ``(series_id, chapter_id, start_ms, end_ms, label)`` as those of a chapter file, which counts frames."""
    frame = lambda c: ms_to_frame(F.col(c), fps).cast("long")
    return chapters.select(
        "series_id", frame("start_ms").alias("start_frame_id"), frame("end_ms").alias("end_frame_id"), F.col("label").alias("class_name"), F.col("label").alias("segment_type"),
        F.col("label").alias("position_short_name"), F.col("label").alias("position_long_name"), F.lit("manual").alias("source"), F.col("chapter_id").cast("string").alias("unique_id"),
    )


def chapter_documents(rows: DataFrame, fps: float = 30.0, created: str = "") -> DataFrame:
    """Chapter files ``(series_id, value)``: one JSON document for each series that has chapters, in order of their frames."""
    fields = [f.split()[0] for f in CHAPTER_FIELDS.split(", ")]
    kept = F.array_sort(F.collect_list(F.struct(*fields))).alias("chapters")
    own = rows.groupBy("series_id").agg(kept, F.max("end_frame_id").alias("_last"))
    document = F.struct(
        F.lit(CHAPTER_VERSION).alias("version"), F.col("series_id").cast("string").alias("video_filename"), F.lit(float(fps)).alias("video_fps"),
        (F.col("_last") + 1).alias("video_total_frames"), F.lit(created).alias("created_timestamp"), F.lit("manual").alias("source"),
        F.size("chapters").alias("chapter_count"), "chapters",
    )
    return own.select("series_id", F.to_json(document).alias("value"))


def parse_chapters(documents: DataFrame) -> DataFrame:
    """``(series_id, video_fps, ...)``: the chapters of chapter files; one without frames, or of a file that is no JSON, is left out."""
    read = documents.select("series_id", F.from_json("value", CHAPTER_FILE).alias("d"))
    rows = read.select("series_id", F.coalesce("d.video_fps", F.lit(30.0)).alias("video_fps"), F.inline("d.chapters"))
    short, long = F.coalesce("position_short_name", "segment_type", F.lit("default")), F.coalesce("position_long_name", "class_name", F.lit("Unknown"))
    rows = rows.where("start_frame_id is not null and end_frame_id is not null")
    return rows.withColumns({"position_short_name": short, "position_long_name": long})


def pattern_documents(rows: DataFrame) -> DataFrame:
    """``patterns`` as JSON documents ``(name, value)``."""
    return rows.select("name", F.to_json(F.struct("name", "duration_ms", "actions")).alias("value"))


def load_patterns(documents: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Patterns ``(name, duration_ms, actions)`` of documents, all or those named; what is no pattern of two points is left out."""
    read = documents.select(F.from_json("value", "name string, duration_ms bigint, actions array<struct<at: bigint, pos: int>>").alias("d")).select("d.*")
    read = read.where(F.col("name").isNotNull() & (F.size("actions") >= 2))
    return read if names is None else read.where(F.col("name").isin(names))
