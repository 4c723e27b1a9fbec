"""Connected components of a link table, by contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import stage


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``id, component_id`` for every end of ``links`` (``a, b`` long); the component is named by its smallest id.

    In each round every node goes over to its neighbour, or itself, of least
    hash (another hash each round), and links are rewritten to the nodes gone
    over to; loops and copies vanish. A star is gone after two rounds and a
    path loses a constant share of its nodes each round, so the rounds grow as
    the logarithm of the longest path. All tables live in the shared folder;
    the driver sees only whether links are left.
    """
    ends = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = stage(ends, "links")
    nodes = None
    for turn in range(max_rounds):
        if ends.isEmpty():
            break
        both = ends.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(ends.select(F.col("b").alias("id"), F.col("a").alias("other")))
        least = F.min(F.struct(F.xxhash64(F.lit(turn), F.col("other")).alias("rank"), F.col("other").alias("to")))
        best = both.groupBy("id").agg(least.alias("best")).withColumn("own", F.xxhash64(F.lit(turn), F.col("id")))
        moved = stage(best.select("id", F.when(F.col("best.rank") < F.col("own"), F.col("best.to")).otherwise(F.col("id")).alias("to")), f"moved-{turn}")
        if nodes is None:
            nodes = moved.select("id", F.col("to").alias("root"))
        else:
            on = moved.select(F.col("id").alias("root"), "to")
            nodes = nodes.join(on, "root", "left").select("id", F.coalesce("to", "root").alias("root"))
        nodes = stage(nodes, f"roots-{turn}")
        left = ends.join(moved.select(F.col("id").alias("a"), F.col("to").alias("ta")), "a").join(moved.select(F.col("id").alias("b"), F.col("to").alias("tb")), "b")
        ends = left.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        ends = stage(ends, f"links-{turn}")
    else:
        raise RuntimeError(f"links are left after {max_rounds} rounds")
    if nodes is None:
        return ends.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    names = nodes.groupBy("root").agg(F.min("id").alias("component_id"))
    return nodes.join(names, "root").select("id", "component_id")
