"""Connected components of a link table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from runsift.llm.common import Shelf, saved


def components(links: DataFrame, save: Callable = saved) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node it can reach.

    Large-star and small-star steps in turn: each node hands its neighbours on to
    the smallest node near it, until every node points at a root and no root points
    on. The neighbours of a node are never gathered; a hub is a join key whose rows
    can be split. Each step is written to the shared folder, and the one before
    removed; `save` stores the result. Links of a node to
    itself are ignored.
    """
    with Shelf() as shelf:
        edges = shelf.saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        while True:
            both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
            large = shelf.saved(both.join(low, both["u"] == low["k"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
            low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
            near = large.join(low, large["u"] == low["k"]).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            edges = shelf.saved(near.where("u <> v").distinct())
            shelf.only(edges)
            now = edges.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("u").alias("d")).first()
            if now["n"] == now["d"] and not edges.join(edges.select(F.col("v").alias("root")), F.col("u") == F.col("root"), "left_semi").take(1):
                break
        return save(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
