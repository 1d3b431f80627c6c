"""Chat formatting with cumulative-snapshot collapse, in built-in functions only.

A log often holds the same conversation again and again, each time a few turns longer. Every prefix of a
conversation gets a rolling hash: the running xor of its turns' hashes, each taken with its position,
twice with different seeds (128 bits). A conversation whose whole hash is another one's proper prefix is
dropped by an anti-join; equal ones leave the smallest id. What is left is rendered.

Scale: a popular first turn is one row after the prefixes are made distinct (with partial aggregation),
and equal conversations are one row before the anti-join, so no key of a join is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, at, role, text, h1, h2)``: turns in order with the rolling hashes up to each."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", "role", "text")
    same = F.lit(True)
    for c in ("turn", "role", "text"):
        same = same & F.lag(c).over(order).eqNullSafe(F.col(c))
    repeated = (F.row_number().over(order) > 1) & same
    rows = rows.withColumn("again", repeated).where("not again").drop("again")
    rows = rows.withColumn("at", F.row_number().over(order))
    # a hash passes over nulls, so what is null is said apart; a null text reads as an empty one, a null role does not
    value = [F.col("at"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    for name, seed in (("h1", 1), ("h2", 2)):
        rows = rows.withColumn(name, F.xxhash64(F.lit(seed), *value)).withColumn(name, F.expr(f"bit_xor({name})").over(so_far))
    return rows


def maximal(rows: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, n_same)`` of conversations that no longer one starts with; of equal ones the smallest id."""
    whole = Window.partitionBy("conv_id")
    ends = rows.select("conv_id", "at", "h1", "h2", F.max("at").over(whole).alias("n"))
    full = ends.where("at = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_same"))
    inner = ends.where("at < n").select(F.col("at").alias("n"), "h1", "h2").distinct()
    return full.join(inner, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_same")


def rendered(role: Column, text: Column) -> Column:
    """One turn in the chat markup; a null role is ``unknown``, a null text empty."""
    return F.concat(F.lit(START), F.coalesce(role, F.lit("unknown")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(END + "\n"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """Rows ``(conv_id, n_turns, n_same, n_chars, text)``, one for each maximal conversation.

    Turns come in order of ``turn``, then role, then text, nulls first. A row that repeats a turn wholly
    counts once. Two turns are alike if their roles are equal (null is a role of its own) and their texts are
    (a null text counts as empty). Rows without a conv_id belong to no conversation and are left out. ``n_same`` counts the
    conversations that are equal to this one, itself included. An empty table gives no rows; other columns
    are not read.
    """
    rows = turns(conversations)
    kept = maximal(rows)
    line = rows.select("conv_id", F.struct("at", rendered(F.col("role"), F.col("text")).alias("line")).alias("t"))
    whole = line.join(kept, "conv_id").groupBy("conv_id").agg(
        F.any_value("n_turns").alias("n_turns"), F.any_value("n_same").alias("n_same"), F.sort_array(F.collect_list("t")).alias("t")
    )
    text = F.array_join(F.col("t.line"), "")
    return whole.select("conv_id", "n_turns", "n_same", F.length(text).cast("long").alias("n_chars"), text.alias("text"))


SQL = """
WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM d
), p AS (
  SELECT conv_id, pos, count(*) OVER (PARTITION BY conv_id) AS n,
         list(struct_pack(n := role IS NULL, r := coalesce(role, ''), x := coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY pos) AS turns,
         string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '')
           OVER (PARTITION BY conv_id ORDER BY pos) AS text
  FROM t
), f AS (
  SELECT turns, min(conv_id) AS conv_id, any_value(n) AS n_turns, count(*) AS n_same, arg_min(text, conv_id) AS text
  FROM p WHERE pos = n GROUP BY turns
)
SELECT conv_id, n_turns, n_same, length(text) AS n_chars, text FROM f
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.turns = f.turns)
"""
