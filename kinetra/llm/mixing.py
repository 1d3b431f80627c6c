"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash of its id and text. Sizes are summed by source and leading hash bits; the running sum
gives, for each source, the bucket in which its budget ends. Only documents of these boundary buckets are
summed again by the next bits, until a bucket holds one hash value. What lies under the threshold is taken
once more than the rest: budgets are nested, so a larger target always takes a superset, and nothing is
sorted. The histogram has at most 1,024 rows for each source and level, whatever a source's share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetra.llm.common import materialize, scratch, word_count

HASH_BITS, LEVEL_BITS = 60, 10
#: Weights of the sources in code-point order, null last; repeated.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size, h)`` of every row."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), hash_of(docs["doc_id"], docs["text"]).alias("h"))


def hash_of(doc_id: Column, text: Column) -> Column:
    """A document's hash: of the id and the text, so that rows without an id or with equal ids are told apart by their texts."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(source, source_size, target)``: all words shared by weight, none above ``max_repeats`` times its size.

    A source is capped where the level, words for each unit of weight, exceeds its cap for each unit. In
    order of that ratio the capped sources come first, so the level after the first k are capped is
    (words - their caps) / (weights - their weights), and the first level that fits the next source holds.
    The windows run over one row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    by = by.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int")).alias("w"))
    by = by.withColumn("cap", F.col("source_size") * max_repeats).withColumn("ratio", F.col("cap") / F.col("w"))
    ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    by = by.withColumn(
        "level",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))),
    )
    by = by.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(every)["level"])
    return by.select(
        "source",
        "source_size",
        F.least(F.col("cap").cast("double"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("w")).alias("target"),
    )


def thresholds(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(source, source_size, target, times, below)``: a document is taken ``times`` times, once more if ``h < below``.

    The unit at the boundary is one hash value; it is taken if that brings the source nearer to its target.
    """
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = materialize(
        wanted.withColumn("times", times.cast("long")).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size")),
        "plan",
    )
    open_ = plan.where("rest > 0").select(F.col("source").alias("s"), "rest", F.lit(0).cast("long").alias("at"))
    done, bits = None, 0
    while True:
        bits += LEVEL_BITS
        shift, last = HASH_BITS - bits, bits >= HASH_BITS
        cell = F.shiftright("h", shift)
        same = sizes["source"].eqNullSafe(F.col("s")) & (F.shiftright("h", min(shift + LEVEL_BITS, 63)) == F.col("at"))
        inside = sizes.join(open_, same).groupBy("s", "rest", cell.alias("cell"))
        cells = inside.agg(F.sum("size").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        run = Window.partitionBy("s").orderBy("cell")
        cells = cells.withColumn("upto", F.sum("n").over(run))
        met = cells.where("upto >= rest").groupBy("s").agg(F.min(F.struct("cell", "rest", "n", "upto", "lo", "hi")).alias("c"))
        met = materialize(met.select("s", "c.*"), "boundary")
        single = met.where("lo = hi or " + str(last).lower())
        gap = F.col("rest") - (F.col("upto") - F.col("n"))
        ended = single.select("s", F.when(F.col("n") - gap <= gap, F.col("lo") + 1).otherwise(F.col("lo")).alias("below"))
        done = ended if done is None else done.unionByName(ended)
        more = met.where("lo <> hi")
        if last or more.isEmpty():
            break
        open_ = more.select("s", gap.alias("rest"), F.col("cell").alias("at"))
    everything = F.when(F.col("rest") > 0, F.lit(1 << HASH_BITS)).otherwise(F.lit(0)).cast("long")
    return materialize(
        plan.join(done, plan["source"].eqNullSafe(F.col("s")), "left").select(
            "source", "source_size", "target", "times", F.coalesce("below", everything).alias("below")
        ),
        "thresholds",
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Rows ``(doc_id, size, source_size, target, taken)``, one for each row of ``docs(doc_id, text, source)``.

    ``taken`` is the document's words times its number of uses. Null texts have size 0, a null source is a
    source of its own, rows of equal id and text (null ids too) are taken alike. A source without words has
    target 0. An empty table gives no rows; other columns are not read.
    """
    with scratch(docs.sparkSession) as keep:
        sizes = keep(materialize(sized(docs), "sizes"))
        plan = keep(thresholds(sizes, targets(sizes, weights, max_repeats))).withColumnRenamed("source", "s")
    uses = F.col("times") + (F.col("h") < F.col("below")).cast("long")
    return sizes.join(plan, sizes["source"].eqNullSafe(F.col("s"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * uses).alias("taken")
    )


def take(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is used, with its own columns."""
    with scratch(docs.sparkSession) as keep:
        sizes = materialize(sized(docs), "sizes")
        plan = keep(thresholds(sizes, targets(sizes, weights, max_repeats)))
    plan = plan.select(F.col("source").alias("mix_source"), F.col("times").alias("mix_times"), F.col("below").alias("mix_below"))
    uses = plan["mix_times"] + (hash_of(docs["doc_id"], docs["text"]) < plan["mix_below"]).cast("long")
    # the table's columns travel in one struct, so that none clashes with those of the plan
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    used = docs.join(plan, docs["source"].eqNullSafe(plan["mix_source"])).select(row, uses.alias("uses"))
    return used.where("uses > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("uses").cast("int")))).select("row.*")


#: The same rows in DuckDB: sums by hash value in hash order instead of histograms.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
         3 * source_size AS cap
  FROM s
), l AS (
  SELECT *, cap / w AS ratio,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size,
         least(CAST(cap AS DOUBLE), w * (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio)) AS target
  FROM l
), u AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM t
), g AS (
  SELECT u.source, h, CAST(sum(size) AS BIGINT) AS n, any_value(target - times * source_size) AS rest
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source GROUP BY u.source, h
), c AS (
  SELECT source, h, n, rest, CAST(sum(n) OVER (PARTITION BY source ORDER BY h) AS BIGINT) AS upto FROM g
)
SELECT d.doc_id, d.size, u.source_size, u.target,
       d.size * (u.times + CASE WHEN rest > 0 AND (upto <= rest OR (upto - n < rest AND upto - rest <= rest - (upto - n)))
                                THEN 1 ELSE 0 END) AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.h = d.h
"""
