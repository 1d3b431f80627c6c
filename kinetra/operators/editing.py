"""Set operations on series: replacing, copying, moving and slicing points; chapters from labels and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetra.operators.joins import value_at
from kinetra.operators.sequential import min_interval_filter
from kinetra.functions.numbers import snap_to_frame
from kinetra.schema import KEY, rint, series


def last_wins(points: DataFrame) -> DataFrame:
    """One row for each time of a series: that of highest ``seq``."""
    order = Window.partitionBy(*KEY, "at").orderBy(F.desc("seq"))
    return points.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def add_batch(points: DataFrame, new: DataFrame, fps: float = 0, gap: int = 10) -> DataFrame:
    """Union of both, new points on frames (if ``fps``), of equal times the later ``seq``, at least ``gap`` ms apart."""
    if fps > 0:
        new = new.withColumn("at", snap_to_frame(F.col("at"), fps))
    return min_interval_filter(points.unionByName(new), gap)


def replace_range(points: DataFrame, new: DataFrame, start: int, end: int) -> DataFrame:
    """Drop the range's points, add the new ones, keep the last of equal times."""
    return last_wins(points.where(~F.col("at").between(start, end)).unionByName(new))


def merge_recording(points: DataFrame, recorded: DataFrame) -> DataFrame:
    """Union in which equal times stay."""
    return points.unionByName(recorded)


def paste(points: DataFrame, copied: DataFrame, at: int, replace: bool = False) -> DataFrame:
    """``copied`` re-timed so that its first point (over all axes of a series) comes at ``at``; last wins.

    ``replace`` clears the covered time of the axes that are pasted to first.
    """
    base = Window.partitionBy("series_id")
    moved = copied.withColumn("at", F.col("at") - F.min("at").over(base) + at)
    if replace:
        span = moved.groupBy(*KEY).agg(F.min("at").alias("_a"), F.max("at").alias("_z"))
        points = points.join(span, list(KEY), "left").where(~F.coalesce(F.col("at").between(F.col("_a"), F.col("_z")), F.lit(False))).drop("_a", "_z")
    return last_wins(points.unionByName(moved))


def copy_axis(points: DataFrame, source: str, target: str) -> DataFrame:
    """The target axis becomes a copy of the source."""
    copy = points.where(F.col("axis") == source).withColumn("axis", F.lit(target))
    return points.where(F.col("axis") != target).unionByName(copy.select(points.columns))


def swap_axes(points: DataFrame, a: str, b: str) -> DataFrame:
    name = F.when(F.col("axis") == a, b).when(F.col("axis") == b, a).otherwise(F.col("axis"))
    return points.withColumn("axis", name)


def slice_clip(points: DataFrame, start: int, end: int) -> DataFrame:
    """A clip from time 0: interpolated points at 1 ms and 1 ms before its end, and the points strictly between these."""
    length = end - start
    inner = points.where(F.col("at").between(start, end)).select(*KEY, (F.col("at") - start).alias("at"), "pos")
    inner = inner.where((F.col("at") > 1) & (F.col("at") < length - 1))
    edges = points.select(*KEY).distinct().withColumn("t", F.explode(F.array(F.lit(start), F.lit(end)))).withColumn("t", F.col("t").cast("long"))
    found = value_at(points, edges).select(*KEY, F.when(F.col("t") == start, 1).otherwise(length - 1).cast("long").alias("at"), "pos")
    return inner.unionByName(found)


def merge_chapter_results(points: DataFrame, chapters: DataFrame, held: Column) -> DataFrame:
    """Points of all chapters; one without points is held at ``held`` at both ends.

    Of equal times the last wins: points before ends, later chapters (``ord``) before earlier ones.
    """
    # the next point from a chapter's start on, by one pass back in time
    c = chapters.select("series_id", F.col("start_ms").alias("_t"), F.lit(1).alias("_k"), F.struct(*chapters.columns).alias("_c"))
    p = points.select("series_id", F.col("at").alias("_t"), F.lit(0).alias("_k"), F.col("at").alias("_next"))
    back = Window.partitionBy("series_id").orderBy(F.desc("_t"), "_k").rowsBetween(Window.unboundedPreceding, 0)
    both = c.unionByName(p, allowMissingColumns=True).withColumn("_next", F.last("_next", ignorenulls=True).over(back)).where("_k = 1")
    bare = both.where("_next is null or _next > _c.end_ms").select("_c.*")
    ends = bare.select(
        "series_id", F.lit("stroke").alias("axis"), F.explode(F.array("start_ms", "end_ms")).alias("at"), held.cast("int").alias("pos"), (F.col("ord") - 1000).cast("long").alias("seq")
    )
    return last_wins(points.unionByName(ends.withColumn("at", F.col("at").cast("long"))))


def label_runs(frames: DataFrame, label: str = "label") -> DataFrame:
    """Runs of equal labels in frame order: ``(series_id, start_frame, end_frame, label, frames)``."""
    order = Window.partitionBy("series_id").orderBy("frame_id")
    rows = frames.withColumn("_new", (~F.col(label).eqNullSafe(F.lag(label).over(order)) | (F.row_number().over(order) == 1)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(order))
    runs = rows.groupBy("series_id", "_run", F.col(label).alias("label")).agg(F.min("frame_id").alias("start_frame"), F.max("frame_id").alias("end_frame"), F.count("*").alias("frames"))
    return runs.drop("_run")


def majority_vote(frames: DataFrame, labels: list[str], idle: list[str], half_window: int, least: float = 0.12) -> DataFrame:
    """``vote``: the commonest active label within ``half_window`` frames, or the first idle label if under ``least`` are active.

    Ties go to the label whose first frame in the window is earliest. Counts run as one window sum for each
    label, so the window is never gathered.
    """
    near = Window.partitionBy("series_id").orderBy("frame_id").rangeBetween(-half_window, half_window)
    rows = frames.withColumn("_n", F.count("*").over(near))
    active = [x for x in labels if x not in idle]
    for i, name in enumerate(active):
        hit = F.when(F.col("label") == name, F.col("frame_id"))
        rows = rows.withColumns({f"_c{i}": F.count(hit).over(near), f"_f{i}": F.min(hit).over(near)})
    total = sum((F.col(f"_c{i}") for i in range(len(active))), F.lit(0))
    best = F.greatest(*[F.when(F.col(f"_c{i}") > 0, F.struct(F.col(f"_c{i}").alias("c"), (-F.col(f"_f{i}")).alias("f"), F.lit(x).alias("x"))) for i, x in enumerate(active)])
    vote = F.when(total / F.col("_n") >= least, F.coalesce(best["x"], F.lit(idle[0]))).otherwise(F.lit(idle[0]))
    return rows.withColumn("vote", vote).select(*frames.columns, "vote")


def chapters_validate(chapters: DataFrame, total: int) -> DataFrame:
    """Issues of chapters in start order: ``(series_id, n, issue)``; n counts from 1."""
    order = Window.partitionBy("series_id").orderBy("start_frame", "end_frame")
    rows = chapters.select("series_id", "start_frame", "end_frame", F.row_number().over(order).alias("n"), F.lead("start_frame").over(order).alias("_next"))
    kinds = F.array(
        F.when(F.col("_next").isNotNull() & (F.col("start_frame") >= F.col("end_frame")), F.lit("invalid range")),
        F.when(F.col("end_frame") >= F.col("_next"), F.lit("overlap")),
        F.when(F.col("end_frame") >= total, F.lit("beyond end")),
        F.when(F.col("start_frame") < 0, F.lit("negative start")),
    )
    return rows.select("series_id", "n", F.explode(kinds).alias("issue")).where("issue is not null")


def chapters_repair(chapters: DataFrame) -> DataFrame:
    """End of each chapter at most one frame before the next starts."""
    order = Window.partitionBy("series_id").orderBy("start_frame", "end_frame")
    return chapters.withColumn("_next", F.lead("start_frame").over(order)).withColumn("end_frame", F.coalesce(F.least("end_frame", F.col("_next") - 1), F.col("end_frame"))).drop("_next")


def clip_to_range(rows: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """Chapters that share a frame with the range, or points ``frame_id`` in it; without ``end``, or with -1, it has no end."""
    points = "frame_id" in rows.columns
    first, last = ("frame_id", "frame_id") if points else ("start_frame", "end_frame")
    return rows.where((F.col(last) >= start) & (F.lit(end is None or end == -1) | (F.col(first) <= (end or 0))))


def chapter_place(chapters: DataFrame, start: int, end: int) -> DataFrame:
    """Where a new chapter of ``start`` to ``end`` fits each series: ``(series_id, start_frame, end_frame)``.

    There, if free; else just before the first chapter it meets, if there is room from the start of the
    video; else just after the last it meets, if free; else the first gap that holds it; else after all.
    """
    length = end - start
    order = Window.partitionBy("series_id").orderBy("start_frame", "end_frame")
    meets = (F.greatest(F.lit(start), "start_frame") <= F.least(F.lit(end), "end_frame"))
    rows = chapters.withColumns({"_m": meets, "_next": F.lead("start_frame").over(order), "_prev": F.lag("end_frame").over(order)})
    gap = F.when(F.col("_next").isNotNull() & (F.col("_next") - F.col("end_frame") - 1 >= length), F.struct(F.row_number().over(order).alias("i"), (F.col("end_frame") + 1).alias("s")))
    rows = rows.withColumn("_gap", gap)
    whole = Window.partitionBy("series_id")
    rows = rows.withColumns({"_first": F.min(F.when(F.col("_m"), F.col("start_frame"))).over(whole), "_last": F.max(F.when(F.col("_m"), F.col("end_frame"))).over(whole)})
    after = F.col("_last") + 1
    clash = ~F.col("_m") & (F.greatest(after, "start_frame") <= F.least(after + length - 1, "end_frame"))
    out = rows.groupBy("series_id").agg(
        F.first("_first").alias("first"), F.first("_last").alias("last"), F.max(clash).alias("clash"), F.min("_gap").alias("gap"),
        F.max_by("end_frame", F.struct("start_frame", "end_frame")).alias("end"),
    )
    place = F.when(F.col("first").isNull(), F.lit(start)).when(F.col("first") >= length, F.col("first") - length)
    place = place.when(~F.col("clash"), F.col("last") + 1).otherwise(F.coalesce(F.col("gap.s"), F.col("end") + 1))
    stop = F.when(F.col("first").isNull(), F.lit(end)).otherwise(place + length - 1)
    return out.select("series_id", place.alias("start_frame"), stop.alias("end_frame"))


def chapter_split(chapters: DataFrame, frame: int) -> DataFrame:
    """Every chapter that holds ``frame`` inside becomes two, the second from that frame on."""
    inside = (F.col("start_frame") < frame) & (F.col("end_frame") >= frame)
    parts = F.when(inside, F.array(F.struct(F.col("start_frame").alias("a"), F.lit(frame - 1).cast("long").alias("z")), F.struct(F.lit(frame).cast("long").alias("a"), F.col("end_frame").alias("z"))))
    parts = F.coalesce(parts, F.array(F.struct(F.col("start_frame").alias("a"), F.col("end_frame").alias("z"))))
    keep = [c for c in chapters.columns if c not in ("start_frame", "end_frame")]
    return chapters.select(*keep, F.explode(parts).alias("_p")).select(*keep, F.col("_p.a").alias("start_frame"), F.col("_p.z").alias("end_frame"))


def sections_to_chapters(sections: DataFrame, fps: float) -> DataFrame:
    """Problem sections as chapters on frames, end inclusive and not before the start."""
    frame = lambda c: rint(F.col(c) * F.lit(float(fps)) / 1000)
    return sections.select(*KEY, frame("start_ms").alias("start_frame"), F.greatest(frame("start_ms"), frame("end_ms")).alias("end_frame"))


def to_frames(points: DataFrame) -> DataFrame:
    """Points as frames in time order, one frame each."""
    return points.withColumn("frame_id", F.row_number().over(series()))
