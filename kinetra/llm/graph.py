"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import materialize


def connected(edges: DataFrame) -> DataFrame:
    """Map every node of ``edges(a, b)`` to one ``root`` of its component: rows ``(node, root)``.

    Each round every node joins the neighbour (or itself) of smallest hash, links are renamed and
    those inside a node vanish. The hash changes with the round, so a long chain also shrinks by a
    constant share. The result of a round is a written table; no links reach the driver.
    """
    links = materialize(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
    )
    labels = None
    turn = 0
    while not links.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        both = links.select(F.col("a").alias("node"), rank("b").alias("r")).unionByName(
            links.select(F.col("b").alias("node"), rank("a").alias("r"))
        )
        best = both.groupBy("node").agg(F.min("r").alias("r"))
        step = materialize(best.select("node", F.least("r", rank("node"))["id"].alias("to")), "step")
        if labels is None:
            labels = step.withColumnRenamed("to", "root")
        else:
            moved = step.withColumnRenamed("node", "root")
            labels = materialize(
                labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels"
            )
        left = step.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        links = materialize(
            links.join(left, "a")
            .join(right, "b")
            .where("a2 <> b2")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
            .distinct(),
            "links",
        )
        turn += 1
    if labels is None:
        labels = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
