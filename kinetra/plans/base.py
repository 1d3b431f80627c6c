"""How the standard tables are read as motion data, in Spark and in DuckDB, and the registry of queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetra.schema import KEY

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with DuckDB SQL for the same rows where there is any."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = re.sub(r"\bat\b", '"at"', sql)  # a keyword of DuckDB
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_points(spark: SparkSession, sf_dir: str, axis: str | None = "stroke") -> DataFrame:
    """Points from ``events``: 30 days pressed into 72 s, positions limited to 100; axis None takes the event type."""
    events = table(spark, sf_dir, "events")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)")
    return events.select(
        F.col("user_id").alias("series_id"),
        (F.lit(axis) if axis else F.col("event_type")).alias("axis"),
        F.floor(micros / 36000000).cast("long").alias("at"),
        F.least(F.lit(100), F.floor("value")).cast("int").alias("pos"),
        F.col("event_id").alias("seq"),
    )


def last_wins(points: DataFrame) -> DataFrame:
    """One row for each time of a series: the one of highest ``seq``."""
    order = Window.partitionBy(*KEY, "at").orderBy(F.desc("seq"))
    return points.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def points(spark: SparkSession, sf_dir: str, axis: str | None = "stroke") -> DataFrame:
    return last_wins(raw_points(spark, sf_dir, axis))


RAW_SQL = """raw AS (
  SELECT user_id AS series_id, 'stroke' AS axis, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 36000000 AS at,
         CAST(least(100, floor(value)) AS INTEGER) AS pos, event_id AS seq, event_type
  FROM events
)"""
POINTS_SQL = (
    RAW_SQL
    + """, points AS (
  SELECT series_id, axis, at, pos, seq FROM raw QUALIFY row_number() OVER (PARTITION BY series_id, axis, at ORDER BY seq DESC) = 1
)"""
)
AXES_SQL = (
    RAW_SQL
    + """, points AS (
  SELECT series_id, event_type AS axis, at, pos, seq FROM raw
  QUALIFY row_number() OVER (PARTITION BY series_id, event_type, at ORDER BY seq DESC) = 1
)"""
)
#: The window of a series.
W = "(PARTITION BY series_id, axis ORDER BY at, seq)"


def on_points(body: str) -> str:
    return f"WITH {POINTS_SQL}\n{body}"
