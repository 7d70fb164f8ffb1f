"""Connected components of links that no task or driver holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hearthstat.llm.common import drop, follow, stage


def components(links: DataFrame) -> DataFrame:
    """The smallest id reachable from every linked id: (id, component), from links (a, b).

    Each round lets every id hand its larger neighbours, then its smaller ones, to the smallest neighbour, until nothing
    changes; the number of rounds grows with the logarithm of a component's size. Neighbours are never gathered: a round
    is minima by id, combined on the map side, and a join. Ids without links are not returned; self links are ignored.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        high = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = high.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        moved = high.join(low, F.col("u") == F.col("k")).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        last, edges = edges, stage(moved.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u > v").distinct(), "links")
        drop(last)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = edges.select("v").distinct()
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return follow(found.unionByName(roots.select(F.col("v").alias("id"), F.col("v").alias("component"))), edges)
