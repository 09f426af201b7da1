"""Connected components of a link table, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node reachable.

    Each round every node points to its smallest neighbour, pointers are followed to their
    ends by doubling, and the ends become the nodes of the next round, at most half as many.
    Aggregates combine before the shuffle, so a node with very many links stays cheap. Null
    ends and self links are ignored; no links give no rows.
    """
    edges = keep(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
                 .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    known = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
                    .select("node", F.least("node", "low").alias("root")))
        while True:
            upper = step.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = keep(step.join(upper, "root").select("node", F.col("above").alias("root"),
                                                          (F.col("above") != F.col("root")).alias("moved")))
            step = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        if known is None:
            known = step
        else:
            later = step.select(F.col("node").alias("root"), F.col("root").alias("above"))
            known = keep(known.join(later, "root", "left")
                         .select("node", F.coalesce("above", "root").alias("root")))
        to_a = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to_b = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = keep(edges.join(to_a, "a").join(to_b, "b").where("ra <> rb")
                     .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if known is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).where("false")
    return known
