"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.shared import cut


def _state(edges: DataFrame) -> tuple:
    """What tells two edge tables apart: their size and a sum over their rows."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: each node's neighbours are tied to the least node around it.

    large: the neighbours greater than the node move; otherwise those less than it.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges -> (node, root): root is the least node that node reaches.

    Alternates large-star and small-star steps until the edges are stars; each round is a written
    table. Nodes without edges don't appear. Loops and repeated edges change nothing; null ends are
    dropped. An empty table gives an empty table.
    """
    edges = cut(edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        edges = cut(_star(_star(edges, True), False), "edges")
        now = _state(edges)
        if now == before:
            break
        before = now
    stars = edges.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
