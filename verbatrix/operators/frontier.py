"""Graphs of links: bounded breadth-first search and a best-first frontier with a budget a site."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbatrix.operators.sizing import join_measured, materialise


def bounded_bfs(edges: DataFrame, seeds: DataFrame, depth: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, depth) of the nodes within `depth` steps of the seeds (column node), each at its least depth.

    A step is a join of the frontier with the edges; what was reached is cut out by an anti join and written before the
    next, so lineage stays short. Ends early when nothing new is reached. Nulls are no nodes.
    """
    reached = materialise(seeds.select("node").filter(F.col("node").isNotNull()).distinct().withColumn("depth", F.lit(0)))
    front = reached
    links = edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).filter(F.col("node").isNotNull() & F.col("next").isNotNull())
    for step in range(1, depth + 1):
        met = join_measured(links, front.select("node"), ["node"], "left_semi").select(F.col("next").alias("node")).distinct()
        front = materialise(met.join(reached.select("node"), "node", "left_anti").withColumn("depth", F.lit(step)))
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached


def frontier(links: DataFrame, done: DataFrame, site: str, url: str, score: str, depth: str, budget: int, deepest: int) -> DataFrame:
    """The next `budget` links of every site, best score first, then least depth, then address, with their place.

    A link is queued once, at its best; done ones (column url) and those below `deepest` are left out. The place is a rank
    within a site up to the budget, which the window drops rows by before it sorts them.
    """
    best = links.filter(F.col(url).isNotNull() & (F.col(depth) <= deepest)).groupBy(site, url).agg(F.max(score).alias(score), F.min(depth).alias(depth))
    fresh = best.join(done.select(url).distinct(), url, "left_anti")
    w = Window.partitionBy(site).orderBy(F.desc(score), F.asc(depth), F.asc(url))
    return fresh.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= budget)
