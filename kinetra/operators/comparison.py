"""Comparison of two series by their reversal peaks: classes of the matches, and what each chapter has of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.operators.compound import match_peaks
from kinetra.operators.joins import intervals_of
from kinetra.operators.stats import classify_match
from kinetra.schema import KEY

CLASSES = ("gold", "green", "yellow", "red")


def classified_peaks(main: DataFrame, ref: DataFrame, fps: float = 30.0, window: float = 500, tolerance: float = 2) -> DataFrame:
    """``match_peaks`` with the class of every match, null where a peak has no partner."""
    rows = match_peaks(main, ref, window, tolerance)
    own = classify_match(F.col("offset"), F.abs(F.col("pos") - F.col("ref_pos")), fps)
    return rows.withColumn("class", F.when(F.col("kind") == "matched", own))


def peak_classes(peaks: DataFrame) -> DataFrame:
    """Counts of matched and unmatched peaks and of the classes, for each series."""
    count = lambda c: F.count(F.when(c, 1))
    return peaks.groupBy(*KEY).agg(
        *[count(F.col("kind") == k).alias(c) for k, c in (("matched", "matched"), ("main", "unmatched_main"), ("ref", "unmatched_ref"))],
        F.count("*").alias("total"),
        *[count(F.col("class") == c).alias(c) for c in CLASSES],
    )


def peaks_by_chapter(peaks: DataFrame, chapters: DataFrame) -> DataFrame:
    """Peaks and good ones (gold or green) of each chapter, by the time in ``main`` or that of an unmatched reference peak."""
    good = F.count(F.when(F.col("class").isin("gold", "green"), 1))
    timed = peaks.withColumn("at", F.coalesce("at", "ref_at"))
    rows = intervals_of(timed, chapters.where("end_ms > start_ms"))
    out = rows.groupBy(*KEY, "chapter_id").agg(F.count("*").alias("peaks_total"), good.alias("peaks_good"))
    return out.withColumn("peaks_accuracy", F.col("peaks_good") / F.col("peaks_total"))
