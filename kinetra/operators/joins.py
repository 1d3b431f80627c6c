"""As-of, interval and nearest joins of series with queries, chapters and each other.

As-of look-ups are a union of both sides and one ordered window, never a range join; intervals join on the
series first. A window or a group holds one series.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetra.functions.numbers import ms_to_frame
from kinetra.operators.groups import grouped
from kinetra.schema import KEY, clip, rint, series, whole

DEFAULT_POS = 50


def value_at(points: DataFrame, times: DataFrame, spline: bool = False) -> DataFrame:
    """``times(series_id, axis, t, ...)`` with ``value`` (interpolated, clamped to the ends) and ``pos`` (rounded).

    A series without points has 50. A spline (Catmull-Rom, ends doubled) takes three points at least.
    """
    pos = F.col("pos")
    p = points.select(
        *KEY, F.col("at").alias("t"), F.lit(1).alias("_k"), F.col("seq").alias("_s"),
        F.struct(F.col("at"), pos, F.coalesce(F.lag("pos").over(series()), pos).alias("before"), F.coalesce(F.lead("pos").over(series()), pos).alias("after"),
                 F.count("*").over(whole()).alias("n")).alias("_p"),
    )
    extra = [c for c in times.columns if c not in (*KEY, "t")]
    q = times.select(*KEY, "t", F.lit(0).alias("_k"), F.lit(0).cast("long").alias("_s"), F.struct(*extra).alias("_q") if extra else F.lit(None).cast("int").alias("_q"))
    # the point after is the last one of the reversed order: a frame of what follows would be read anew for every row
    forth, back = (Window.partitionBy(*KEY).orderBy(*[f(c) for c in ("t", "_k", "_s")]).rowsBetween(Window.unboundedPreceding, 0) for f in (F.asc, F.desc))
    both = p.unionByName(q, allowMissingColumns=True)
    both = both.withColumns({"_a": F.last("_p", ignorenulls=True).over(forth), "_z": F.last("_p", ignorenulls=True).over(back)}).where("_k = 0")
    a, z = F.col("_a"), F.col("_z")
    f = (F.col("t") - a["at"]) / (z["at"] - a["at"])
    value = a["pos"] + f * (z["pos"] - a["pos"])
    if spline:
        p0, p1, p2, p3 = a["before"], a["pos"], z["pos"], z["after"]
        curve = 0.5 * (2.0 * p1 + (p2 - p0) * f + (2.0 * p0 - 5.0 * p1 + 4.0 * p2 - p3) * f * f + (3.0 * p1 - p0 - 3.0 * p2 + p3) * f * f * f)
        value = F.when(a["n"] >= 3, clip(curve)).otherwise(value)
    value = F.when(a.isNull() & z.isNull(), F.lit(float(DEFAULT_POS))).when(a.isNull(), z["pos"]).when(z.isNull(), a["pos"]).otherwise(value)
    out = both.select(*KEY, "t", *[F.col(f"_q.{c}") for c in extra], value.cast("double").alias("value"))
    return out.withColumn("pos", clip(rint(F.round("value", 9))).cast("int"))


def latest_value(points: DataFrame) -> DataFrame:
    last = F.struct("at", "seq")
    return points.groupBy(*KEY).agg(F.max("at").alias("at"), F.max_by("pos", last).alias("pos"))


def nearest(points: DataFrame, t: float) -> DataFrame:
    """Of each series the time closest to ``t`` (the earlier of two), the next and the one before."""
    at = F.col("at")
    return points.groupBy(*KEY).agg(
        F.min_by("at", F.struct(F.abs(at - t), at)).alias("closest"), F.min(F.when(at > t, at)).alias("next"), F.max(F.when(at < t, at)).alias("previous")
    )


def next_prev_point(points: DataFrame, frame: int, fps: float) -> DataFrame:
    """Of each series the first point on a later frame and the last on an earlier one."""
    f, at = ms_to_frame(F.col("at"), fps), F.col("at")
    return points.groupBy(*KEY).agg(F.min(F.when(f > frame, at)).alias("next_at"), F.max(F.when(f < frame, at)).alias("prev_at"))


def _pieces(chapters: DataFrame) -> DataFrame:
    """``(series_id, _t, hit, chapter_id, label)``: from each time ``_t`` at which a chapter starts or has ended, the first one (by ``ord``) that holds.

    A sweep over the series' chapters: the open ones wait in a heap, and those that have ended leave it when they come up.
    """
    named = chapters.where("series_id is not null").select("series_id", "start_ms", "end_ms", "ord", "chapter_id", "label")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        opens = rows.sort_values("start_ms", kind="stable")
        starts, ends = opens["start_ms"].tolist(), opens["end_ms"].tolist()
        order = [(pd.isna(o), o if not pd.isna(o) else 0, str(c)) for o, c in zip(opens["ord"], opens["chapter_id"], strict=True)]
        times = sorted({t for a, z in zip(starts, ends, strict=True) for t in (a, z + 1)})
        heap: list[tuple] = []
        found, n = [], 0
        for t in times:
            while n < len(starts) and starts[n] <= t:
                heapq.heappush(heap, (*order[n], n))
                n += 1
            while heap and ends[heap[0][-1]] < t:
                heapq.heappop(heap)
            found.append(heap[0][-1] if heap else None)
        hit = [None if i is None else 1 for i in found]
        of = lambda c: [None if i is None else opens[c].iloc[i] for i in found]
        out = pd.DataFrame({"series_id": rows["series_id"].iloc[0], "_t": times, "hit": pd.array(hit, dtype="Int32"), "chapter_id": of("chapter_id"), "label": of("label")})
        return out

    kind = {f.name: f.dataType.simpleString() for f in named.schema}
    return grouped(named, ("series_id",), run, f"series_id {kind['series_id']}, _t long, hit int, chapter_id {kind['chapter_id']}, label {kind['label']}")


def _covered(points: DataFrame, chapters: DataFrame) -> DataFrame:
    """``(_row, _c)``: every point with the first chapter (by ``ord``) that holds its time; ``_c.hit`` is null without one.

    A series' time is cut where a chapter starts or has ended; a point takes the piece that began last before it. Rows
    that are repeated stay, and a point meets one piece, however many chapters there are.
    """
    pieces = _pieces(chapters).select("series_id", "_t", F.lit(0).alias("_k"), F.struct("hit", "chapter_id", "label").alias("_p"))
    rows = points.select("series_id", F.col("at").alias("_t"), F.lit(1).alias("_k"), F.struct(*points.columns).alias("_row"))
    order = Window.partitionBy("series_id").orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(pieces, allowMissingColumns=True)
    return both.withColumn("_c", F.last("_p", ignorenulls=True).over(order)).where("_k = 1").select("_row", "_c")


def within(rows: DataFrame, spans: DataFrame, at: str = "at", start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """``rows`` once for each span of their series that holds their ``at`` (both bounds inclusive), with the span's columns.

    A span goes to the class of its length, the next power of two, and there into the two stretches of this size that it can reach.
    A row looks into one stretch of each class that its series has, so a long span does not make short ones meet all rows.
    """
    own = [c for c in spans.columns if c != "series_id"]
    size = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col(end) - F.col(start) + 1, F.lit(1))))).cast("long")
    s = spans.where(F.col(end) >= F.col(start)).select(F.col("series_id").alias("_own"), F.struct(*own).alias("_span"), size.alias("_size"))
    classes = s.groupBy(F.col("_own").alias("_series")).agg(F.collect_set("_size").alias("_sizes"))  # 64 at most
    first = F.floor(F.col(f"_span.{start}") / F.col("_size"))
    s = s.select("_own", "_span", "_size", F.explode(F.array(first, first + 1)).alias("_b"))
    r = rows.select(F.struct(*rows.columns).alias("_row")).join(classes, F.col("_row.series_id") == F.col("_series"))
    r = r.select("_row", F.explode("_sizes").alias("_class")).withColumn("_at", F.floor(F.col(f"_row.{at}") / F.col("_class")))
    same = (F.col("_row.series_id") == F.col("_own")) & (F.col("_class") == F.col("_size")) & (F.col("_at") == F.col("_b"))
    return r.join(s, same & F.col(f"_row.{at}").between(F.col(f"_span.{start}"), F.col(f"_span.{end}"))).select("_row.*", *[F.col(f"_span.{c}").alias(c) for c in own])


def intervals_of(rows: DataFrame, chapters: DataFrame) -> DataFrame:
    """``rows`` once for each chapter of their series that holds their time, with its ``chapter_id``."""
    return within(rows, chapters.select("series_id", "chapter_id", "start_ms", "end_ms")).select(*rows.columns, "chapter_id")


def label_points(points: DataFrame, chapters: DataFrame) -> DataFrame:
    """``points`` with the id and label of the first chapter (by ``ord``) that holds their time, or null."""
    return _covered(points, chapters).select("_row.*", "_c.chapter_id", "_c.label")


def points_outside(points: DataFrame, chapters: DataFrame) -> DataFrame:
    """Points that no chapter of ``chapters`` holds (idle ones, say)."""
    named = [c for c in ("ord", "chapter_id", "label") if c not in chapters.columns]
    chapters = chapters.withColumns({c: F.lit(None).cast("string") for c in named}) if named else chapters
    return _covered(points, chapters).where("_c.hit is null").select("_row.*")


def chapters_overlap(chapters: DataFrame) -> DataFrame:
    """Pairs of chapters of a series that share a time; each pair once."""
    a, b = chapters.alias("a"), chapters.alias("b")
    meet = (F.col("a.series_id") == F.col("b.series_id")) & (F.col("a.ord") < F.col("b.ord"))
    meet = meet & (F.greatest("a.start_ms", "b.start_ms") <= F.least("a.end_ms", "b.end_ms"))
    return a.join(b, meet).select(F.col("a.series_id").alias("series_id"), F.col("a.chapter_id").alias("first_id"), F.col("b.chapter_id").alias("second_id"))


def interpolated_pairs(main: DataFrame, ref: DataFrame) -> DataFrame:
    """Points of ``main`` within the overlap of both, with the reference's value at their time as ``ref_value``."""
    bounds = lambda df, a, z: df.groupBy(*KEY).agg(F.min("at").alias(a), F.max("at").alias(z))
    span = bounds(main, "_a1", "_z1").join(bounds(ref, "_a2", "_z2"), list(KEY))
    span = span.select(*KEY, F.greatest("_a1", "_a2").alias("start"), F.least("_z1", "_z2").alias("end"), F.col("_a2").alias("ref_start"), F.col("_z2").alias("ref_end"))
    inside = main.join(span.where("end > start"), list(KEY)).where(F.col("at").between(F.col("start"), F.col("end")))
    asked = inside.select(*KEY, F.col("at").alias("t"), F.col("pos").alias("main_pos"), "seq", "start", "end", "ref_start", "ref_end")
    found = value_at(ref, asked)
    return found.select(*KEY, F.col("t").alias("at"), F.col("main_pos").alias("pos"), "seq", F.col("value").alias("ref_value"), "start", "end", "ref_start", "ref_end")


def skip_existing(jobs: DataFrame, outputs: DataFrame, mode: int, author: str, version: str) -> DataFrame:
    """Jobs to run: mode 1 skips those with any output, 0 those with an own one of this version, 2 none."""
    if mode == 2:
        return jobs
    done = outputs if mode == 1 else outputs.where((F.col("author") == author) & (F.col("version") == version))
    return jobs.join(done.select("path"), "path", "left_anti")


def import_types(existing: DataFrame, incoming: DataFrame, mode: str) -> DataFrame:
    """Tables ``(name, value)`` with unique names: on a conflict keep the old, replace it, or add the new as ``name_n``.

    n is the smallest number whose name neither table has.
    """
    both = existing.select("name", F.col("value").alias("old")).join(incoming.select("name", F.col("value").alias("new")), "name", "full")
    if mode in ("skip", "replace"):
        return both.select("name", (F.coalesce("old", "new") if mode == "skip" else F.coalesce("new", "old")).alias("value"))
    names = existing.select("name").union(incoming.select("name")).distinct()
    suffix = names.select(F.regexp_extract("name", r"^(.*)_([0-9]+)$", 1).alias("name"), F.regexp_extract("name", r"^(.*)_([0-9]+)$", 2).try_cast("int").alias("n"))
    used = suffix.where("n is not null").groupBy("name").agg(F.collect_set("n").alias("used"))
    clash = both.where("old is not null and new is not null").join(used, "name", "left")
    taken = F.coalesce("used", F.array().cast("array<int>"))
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size(taken) + 1), taken))
    kept = both.select("name", F.coalesce("old", "new").alias("value"))
    return kept.unionByName(clash.select(F.concat_ws("_", "name", free.cast("string")).alias("name"), F.col("new").alias("value")))


BOX = ("x1", "y1", "x2", "y2")


def iou(a: str, b: str) -> Column:
    """Shared area over joint area of two boxes given by column prefixes."""
    c = lambda p, k: F.col(f"{p}{k}")
    w = F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1"))
    h = F.least(c(a, "y2"), c(b, "y2")) - F.greatest(c(a, "y1"), c(b, "y1"))
    shared = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    area = lambda p: (c(p, "x2") - c(p, "x1")) * (c(p, "y2") - c(p, "y1"))
    joint = area(a) + area(b) - shared
    return F.when(joint > 0, shared / joint).otherwise(F.lit(0.0))


def contacts(boxes: DataFrame, anchor: str, least: float = 0.05) -> DataFrame:
    """Boxes of other classes that touch the anchor of their frame: IoU over ``least``, or apart but with centres
    nearer than half the sum of the diagonals."""
    side = lambda df, p: df.select("series_id", "frame_id", *[F.col(k).alias(f"{p}{k}") for k in (*BOX, "class_name", "box_id")])
    a, b = side(boxes.where(F.col("class_name") == anchor), "a_"), side(boxes.where(F.col("class_name") != anchor), "b_")
    c = lambda p, i, j: (F.col(f"{p}{i}") + F.col(f"{p}{j}")) / 2
    centre = F.hypot(c("a_", "x1", "x2") - c("b_", "x1", "x2"), c("a_", "y1", "y2") - c("b_", "y1", "y2"))
    diagonal = lambda p: F.hypot(F.col(f"{p}x2") - F.col(f"{p}x1"), F.col(f"{p}y2") - F.col(f"{p}y1"))
    rows = a.join(b, ["series_id", "frame_id"]).withColumn("iou", iou("a_", "b_")).withColumn("gap", centre / ((diagonal("a_") + diagonal("b_")) / 2))
    hit = rows.where((F.col("iou") > least) | ((F.col("iou") == 0) & (F.col("gap") < 1)))
    return hit.select("series_id", "frame_id", F.col("a_box_id").alias("anchor_id"), F.col("b_box_id").alias("box_id"), F.col("b_class_name").alias("class_name"), "iou", "gap")


def preferred_box(boxes: DataFrame, anchor: str, width: float | None = None) -> DataFrame:
    """The best box of the anchor class in each frame: the lowest, then the largest; for wide (two-eyed) frames of
    ``width`` the nearest to the middle, then the lowest."""
    cy, cx = (F.col("y1") + F.col("y2")) / 2, (F.col("x1") + F.col("x2")) / 2
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    best = [F.desc(cy), F.desc(area)] if width is None else [F.abs(cx - width / 2), F.desc(cy)]
    order = Window.partitionBy("series_id", "frame_id").orderBy(*best, "box_id", "x1")
    return boxes.where(F.col("class_name") == anchor).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
