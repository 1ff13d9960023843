"""Connected components of a distributed list of links.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014), as joins with each node's least neighbour. A hub is
never gathered: its least neighbour comes from a partial aggregate, and adaptive
execution splits its rows in the join. Each round ends in a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalog.llm.durable import cut, discard


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def stars(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v): each linked node ``u`` but the least, with the least node ``v`` it can reach.

    ``links`` has two long columns, u and v. Self-links, repeats and nulls don't matter.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = cut(edges, "links")
    before = _state(edges)
    for _ in range(most_rounds):
        if not before[0]:
            return edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
        small = small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        old, edges = edges, cut(small.where("u <> v").distinct(), "links")
        discard(old)
        discard(large)
        after = _state(edges)
        if after == before:
            return edges
        before = after
    raise RuntimeError(f"links did not settle in {most_rounds} rounds")
