"""Queries of the set operations, chapters, and job tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetra.operators import editing as E
from kinetra.operators import stats as A
from kinetra.plans.base import AXES_SQL, RAW_SQL, on_points, points, query, raw_points, table
from kinetra.plans.q_joins import ASOF, chapters, on_pairs, with_chapters

S = "(PARTITION BY series_id, axis ORDER BY at, seq)"
C = "series_id, axis, at, pos, seq"
LAST = "QUALIFY row_number() OVER (PARTITION BY series_id, axis, at ORDER BY seq DESC) = 1"


@query(f"WITH {RAW_SQL}\nSELECT {C} FROM raw {LAST}")
def dedup_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return E.last_wins(raw_points(spark, sf))


@query()
def add_batch(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return E.add_batch(p.where("seq % 3 > 0"), p.where("seq % 3 = 0"), 30.0, 400)


@query(
    on_points(f"""SELECT {C} FROM (SELECT {C} FROM points WHERE NOT at BETWEEN 20000 AND 40000
  UNION ALL SELECT series_id, axis, at + 500, pos, seq + 1000000000 FROM points WHERE at BETWEEN 25000 AND 39800) {LAST}""")
)
def replace_range(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    new = p.where("at between 25000 and 39800").withColumns({"at": F.col("at") + 500, "seq": F.col("seq") + 1_000_000_000})
    return E.replace_range(p, new, 20000, 40000)


@query(on_points(f"SELECT {C} FROM points UNION ALL SELECT series_id, axis, at, 100 - pos, seq FROM points WHERE pos > 70"))
def merge_recording(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return E.merge_recording(p, p.where("pos > 70").withColumn("pos", 100 - F.col("pos")))


@query(
    f"""WITH {AXES_SQL}, m AS (SELECT series_id, axis, at - min(at) OVER (PARTITION BY series_id) + 50000 AS at, pos, seq + 1000000000 AS seq FROM points WHERE at BETWEEN 10000 AND 20000),
s AS (SELECT series_id, axis, min(at) AS a, max(at) AS z FROM m GROUP BY ALL)
SELECT {C} FROM (SELECT p.* FROM points p LEFT JOIN s USING (series_id, axis) WHERE NOT coalesce(p.at BETWEEN a AND z, false) UNION ALL SELECT {C} FROM m) {LAST}"""
)
def copy_paste(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf, None)
    return E.paste(p, p.where("at between 10000 and 20000").withColumn("seq", F.col("seq") + 1_000_000_000), 50000, replace=True).select("series_id", "axis", "at", "pos", "seq")


@query(f"WITH {AXES_SQL}\nSELECT {C} FROM points WHERE axis <> 'view' UNION ALL SELECT series_id, 'view', at, pos, seq FROM points WHERE axis = 'click'")
def copy_axis(spark: SparkSession, sf: str) -> DataFrame:
    return E.copy_axis(points(spark, sf, None), "click", "view").select("series_id", "axis", "at", "pos", "seq")


@query(f"WITH {AXES_SQL}\nSELECT series_id, CASE axis WHEN 'click' THEN 'view' WHEN 'view' THEN 'click' ELSE axis END AS axis, at, pos, seq FROM points")
def swap_axes(spark: SparkSession, sf: str) -> DataFrame:
    return E.swap_axes(points(spark, sf, None), "click", "view").select("series_id", "axis", "at", "pos", "seq")


@query(
    on_points("SELECT 0").replace(
        "\nSELECT 0",
        f""", {ASOF.replace("unnest(range(0, 71401, 1700))", "unnest([12345, 45678])")}
SELECT series_id, axis, at - 12345 AS at, pos FROM points WHERE at BETWEEN 12345 AND 45678 AND at - 12345 > 1 AND at - 12345 < 33332
UNION ALL SELECT series_id, axis, CASE t WHEN 12345 THEN 1 ELSE 33332 END, CAST(round_even(round(CASE WHEN pa IS NULL THEN pz WHEN pz IS NULL THEN pa ELSE pa + f * (pz - pa) END, 9), 0) AS INTEGER)
FROM j WHERE series_id >= 0""",
    )
)
def slice_clip(spark: SparkSession, sf: str) -> DataFrame:
    return E.slice_clip(points(spark, sf), 12345, 45678)


@query(
    with_chapters("""SELECT series_id, axis, at, pos, seq FROM (SELECT series_id, axis, at, pos, seq FROM points WHERE pos < 30
  UNION ALL SELECT series_id, 'stroke', unnest([start_ms, end_ms]), CASE WHEN label = 'idle' THEN 100 ELSE 50 END, ord - 1000 FROM chapters c
    WHERE NOT EXISTS (SELECT 1 FROM points p WHERE p.pos < 30 AND p.series_id = c.series_id AND p.at BETWEEN c.start_ms AND c.end_ms))
QUALIFY row_number() OVER (PARTITION BY series_id, axis, at ORDER BY seq DESC) = 1""")
)
def merge_chapter_results(spark: SparkSession, sf: str) -> DataFrame:
    ch = chapters(spark, sf)
    return E.merge_chapter_results(points(spark, sf).where("pos < 30"), ch, F.when(F.col("label") == "idle", 100).otherwise(50)).select("series_id", "axis", "at", "pos", "seq")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled frames: the event type of each event of a user in time order."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select(F.col("user_id").alias("series_id"), F.row_number().over(order).cast("long").alias("frame_id"), F.col("event_type").alias("label"))


FRAMES = "frames AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_id, event_type AS label FROM events)"
RUNS = """runs AS (SELECT series_id, label, min(frame_id) AS start_frame, max(frame_id) AS end_frame, count(*) AS frames FROM (
  SELECT *, sum(CASE WHEN b IS NULL OR b <> label THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY frame_id) AS run FROM (
    SELECT *, lag(label) OVER (PARTITION BY series_id ORDER BY frame_id) AS b FROM frames)) GROUP BY series_id, label, run)"""


@query(f"WITH {FRAMES}, {RUNS} SELECT * FROM runs")
def runs_to_segments(spark: SparkSession, sf: str) -> DataFrame:
    return E.label_runs(frames(spark, sf))


def _labels(spark: SparkSession, sf: str) -> list[str]:
    return ["click", "error", "purchase", "signup", "view"]


@query(
    f"""WITH {FRAMES}, c AS (SELECT a.series_id, a.frame_id, a.label, b.label AS x, count(*) AS n, min(b.frame_id) AS f
  FROM frames a JOIN frames b ON a.series_id = b.series_id AND b.frame_id BETWEEN a.frame_id - 7 AND a.frame_id + 7 GROUP BY a.series_id, a.frame_id, a.label, b.label),
d AS (SELECT series_id, frame_id, label, sum(n) AS total, coalesce(sum(n) FILTER (WHERE x <> 'view'), 0) AS active, arg_max(x, (n, -f)) FILTER (WHERE x <> 'view') AS best FROM c GROUP BY series_id, frame_id, label)
SELECT series_id, frame_id, label, CASE WHEN active / total::DOUBLE >= 0.7 THEN best ELSE 'view' END AS vote FROM d"""
)
def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    return E.majority_vote(frames(spark, sf), _labels(spark, sf), ["view"], 7, 0.7)


def frame_chapters(spark: SparkSession, sf: str) -> DataFrame:
    return chapters(spark, sf).select("series_id", "chapter_id", "label", (F.col("start_ms") / 40).cast("long").alias("start_frame"), (F.col("end_ms") / 40).cast("long").alias("end_frame"))


FC = "fc AS (SELECT series_id, chapter_id, label, start_ms // 40 AS start_frame, end_ms // 40 AS end_frame FROM chapters)"


def on_fc(body: str) -> str:
    return with_chapters("SELECT 0").replace("\nSELECT 0", f", {FC}\n{body}")


@query(
    on_fc("""SELECT series_id, CAST(n AS INTEGER) AS n, issue FROM (SELECT *, unnest([CASE WHEN nx IS NOT NULL AND start_frame >= end_frame THEN 'invalid range' END, CASE WHEN end_frame >= nx THEN 'overlap' END,
  CASE WHEN end_frame >= 1700 THEN 'beyond end' END]) AS issue FROM (
  SELECT *, row_number() OVER w AS n, lead(start_frame) OVER w AS nx FROM fc WINDOW w AS (PARTITION BY series_id ORDER BY start_frame, end_frame))) WHERE issue IS NOT NULL""")
)
def chapters_validate(spark: SparkSession, sf: str) -> DataFrame:
    return E.chapters_validate(frame_chapters(spark, sf), 1700)


@query(
    on_fc("""SELECT series_id, chapter_id, label, start_frame, coalesce(least(end_frame, lead(start_frame) OVER (PARTITION BY series_id ORDER BY start_frame, end_frame) - 1), end_frame) AS end_frame FROM fc""")
)
def chapters_repair(spark: SparkSession, sf: str) -> DataFrame:
    return E.chapters_repair(frame_chapters(spark, sf))


@query(on_fc("SELECT * FROM fc WHERE start_frame <= 700 AND end_frame >= 400"))
def clip_to_range(spark: SparkSession, sf: str) -> DataFrame:
    return E.clip_to_range(frame_chapters(spark, sf), 400, 700)


@query(on_points("SELECT series_id, axis, at // 40 AS frame_id, pos FROM points WHERE at // 40 >= 400"))
def clip_points_to_range(spark: SparkSession, sf: str) -> DataFrame:
    rows = points(spark, sf).select("series_id", "axis", F.floor(F.col("at") / 40).cast("long").alias("frame_id"), "pos")
    return E.clip_to_range(rows, 400, -1)


@query(
    on_fc("""SELECT series_id, s AS start_frame, CASE WHEN f IS NULL THEN 650 ELSE s + 99 END AS end_frame FROM (
  SELECT series_id, f, CASE WHEN f IS NULL THEN 550 WHEN f >= 100 THEN f - 100
    WHEN NOT EXISTS (SELECT 1 FROM fc o WHERE o.series_id = g.series_id AND NOT greatest(550, o.start_frame) <= least(650, o.end_frame) AND greatest(l + 1, o.start_frame) <= least(l + 100, o.end_frame)) THEN l + 1
    ELSE coalesce(gap, e + 1) END AS s FROM (
    SELECT series_id, min(start_frame) FILTER (WHERE greatest(550, start_frame) <= least(650, end_frame)) AS f, max(end_frame) FILTER (WHERE greatest(550, start_frame) <= least(650, end_frame)) AS l,
      arg_max(end_frame, (start_frame, end_frame)) AS e, arg_min(end_frame + 1, start_frame) FILTER (WHERE nx - end_frame - 1 >= 100) AS gap
    FROM (SELECT *, lead(start_frame) OVER (PARTITION BY series_id ORDER BY start_frame, end_frame) AS nx FROM fc) GROUP BY series_id) g)""")
)
def chapter_place(spark: SparkSession, sf: str) -> DataFrame:
    return E.chapter_place(frame_chapters(spark, sf), 550, 650)


@query(
    on_fc("""SELECT series_id, chapter_id, label, start_frame, end_frame FROM fc WHERE NOT (start_frame < 600 AND end_frame >= 600)
UNION ALL SELECT series_id, chapter_id, label, start_frame, 599 FROM fc WHERE start_frame < 600 AND end_frame >= 600
UNION ALL SELECT series_id, chapter_id, label, 600, end_frame FROM fc WHERE start_frame < 600 AND end_frame >= 600""")
)
def chapter_split(spark: SparkSession, sf: str) -> DataFrame:
    return E.chapter_split(frame_chapters(spark, sf), 600)


@query(
    on_pairs("""SELECT series_id, axis, CAST(round_even(f * 30.0::DOUBLE / 1000, 0) AS BIGINT) AS start_frame, CAST(round_even(z * 30.0::DOUBLE / 1000, 0) AS BIGINT) AS end_frame FROM (
  SELECT series_id, axis, section, min(f) AS f, max(f) + 6000 AS z FROM (
    SELECT *, sum(CASE WHEN p IS NULL OR f - (p + 6000) > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id, axis ORDER BY f) AS section FROM (
      SELECT *, lag(f) OVER (PARTITION BY series_id, axis ORDER BY f) AS p FROM (
        SELECT t.series_id, t.axis, t.f FROM (
          SELECT series_id, axis, s + unnest(range(0, (e - s - 6000) // 3000 + 1)) * 3000 AS f FROM (SELECT DISTINCT series_id, axis, s, e FROM pairs WHERE e - s >= 6000)) t
        JOIN pairs x ON x.series_id = t.series_id AND x.axis = t.axis AND x.at BETWEEN t.f AND t.f + 6000
        GROUP BY t.series_id, t.axis, t.f HAVING count(*) >= 2 AND avg(abs(pos - v)) > 30))) GROUP BY ALL)""")
)
def sections_to_chapters(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return E.sections_to_chapters(A.problem_sections(p.where("seq % 2 = 0"), p.where("seq % 2 = 1"), 6000, 30), 30.0)


@query("SELECT l_shipmode_ AS label, n FROM (SELECT l_returnflag || l_linestatus AS l_shipmode_, count(*) AS n FROM lineitem GROUP BY 1) ORDER BY n DESC, label LIMIT 3")
def usage_topk(spark: SparkSession, sf: str) -> DataFrame:
    uses = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("label"))
    return uses.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(3)


@query("SELECT event_type AS label, max(ts) AS last FROM events GROUP BY 1 ORDER BY last DESC, label LIMIT 5")
def usage_recent(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("label")).agg(F.max("ts").alias("last")).orderBy(F.desc("last"), "label").limit(5)


@query("""SELECT o_orderpriority AS priority, count(*) AS jobs, count(*) FILTER (WHERE o_orderstatus = 'O') AS queued, count(*) FILTER (WHERE o_orderstatus = 'F') AS done,
  count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') * count(*) FILTER (WHERE o_orderstatus = 'O'), 2) AS left_s FROM orders GROUP BY 1""")
def job_summary(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda s: F.count(F.when(F.col("o_orderstatus") == s, 1))
    left = F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))) * of("O")
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count("*").alias("jobs"), of("O").alias("queued"), of("F").alias("done"), of("P").alias("failed"), F.round(left, 2).alias("left_s")
    )


CHECKPOINTS = "SELECT o_custkey AS video, o_orderstatus AS stage, o_orderdate AS saved, o_orderkey AS id FROM orders"


def _checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("video"), F.col("o_orderstatus").alias("stage"), F.col("o_orderdate").alias("saved"), F.col("o_orderkey").alias("id"))


@query(f"SELECT video, stage, max(saved) AS saved, arg_max(id, (saved, id)) AS id FROM ({CHECKPOINTS}) GROUP BY ALL")
def checkpoint_latest(spark: SparkSession, sf: str) -> DataFrame:
    return _checkpoints(spark, sf).groupBy("video", "stage").agg(F.max("saved").alias("saved"), F.max_by("id", F.struct("saved", "id")).alias("id"))


@query(f"SELECT * FROM ({CHECKPOINTS}) QUALIFY row_number() OVER (PARTITION BY video ORDER BY saved DESC, id DESC) <= 3")
def checkpoint_retain(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("video").orderBy(F.desc("saved"), F.desc("id"))
    return _checkpoints(spark, sf).withColumn("_r", F.row_number().over(order)).where("_r <= 3").drop("_r")


@query(f"SELECT stage, count(*) AS n, count(DISTINCT video) AS videos, min(saved) AS oldest, max(saved) AS newest FROM ({CHECKPOINTS}) GROUP BY 1")
def checkpoint_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _checkpoints(spark, sf).groupBy("stage").agg(F.count("*").alias("n"), F.countDistinct("video").alias("videos"), F.min("saved").alias("oldest"), F.max("saved").alias("newest"))


@query("""SELECT o_orderkey AS series_id, n AS found, 1 + o_orderkey % 8 AS expected, n >= 0.95 * (1 + o_orderkey % 8) AS complete
FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def completeness_check(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("found"))
    rows = table(spark, sf, "orders").join(found, F.col("l_orderkey") == F.col("o_orderkey"))
    expected = 1 + F.col("o_orderkey") % 8
    return rows.select(F.col("o_orderkey").alias("series_id"), "found", expected.alias("expected"), (F.col("found") >= 0.95 * expected).alias("complete"))


