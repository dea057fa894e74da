"""Connected components of an undirected graph, as DataFrame steps.

Alternating large-star and small-star passes: each points neighbours at the
smallest id around, until every component is a star on its smallest id. Nodes with
very many neighbours are never gathered; a pass joins edges with one minimum per
node, which Spark's skew join may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mosarea.session import cut_lineage


#: edges that one task reads; small graphs are not spread over more tasks than they need
TASK_EDGES = 200_000


def _settled(edges: DataFrame) -> tuple[DataFrame, bool]:
    """Edges written once and read by few tasks, and whether they are stars already."""
    written = cut_lineage(edges)
    rows, nodes = written.agg(F.count("*"), F.countDistinct("u")).first()
    written = written.coalesce(max(1, -(-rows // TASK_EDGES)))
    # a star: every node has one edge, to a smaller node that has none of its own
    return written, rows == nodes and written.join(written.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def star_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id``, ``label`` (smallest id of the component) for every node that is not its own label.

    Self-loops and repeated edges are allowed; null ends are dropped.
    """
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull() & F.col(b).isNotNull())
    stars, done = _settled(ends.where(ends[2]).where("u <> v").select("u", "v").distinct())
    while not done:
        both = stars.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(stars.select("v", "u"))
        low = both.groupBy("x").agg(F.least("x", F.min("y")).alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        pointed = large.join(small, "u")
        turned = pointed.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars, done = _settled(turned.unionAll(pointed.select("u", F.col("m").alias("v"))).distinct())
    return stars.select(F.col("u").alias("id"), F.col("v").alias("label"))
