"""Problem 4: one group identifier for all records linked directly or by way of others.

First the giant component is peeled: frontier joins run breadth first from the vertex of highest degree and what they
reached is taken out of the edges by an anti-join. The remaining components are labelled by propagating minima along
stars, where every round links the neighbours of a vertex to their smallest neighbour, so that paths shrink
geometrically and a chain of n links takes about log n rounds instead of n.

Where the giant component has a long tail, plain breadth-first search would need one job per link of the tail. The search
therefore ends once a frontier is small against what was reached; the reached part is contracted to one vertex and its
remaining edges take part in the propagation. The result is the same, the number of jobs is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.operators.graph import both_ways, link_edges, star_labels
from listwright.runtime import stored


def member_edges(groups: DataFrame, members: str) -> DataFrame:
    """Edges from the smallest member of each group to its other members, which connect it with fewest rows."""
    ids = F.array_distinct(F.filter(F.col(members), lambda x: x.isNotNull()))
    each = groups.select(F.array_min(ids).alias("u"), F.explode(ids).alias("v"))
    return each.where("u < v").distinct()


def _peel(edges: DataFrame, share: float, depth: int) -> tuple[DataFrame, DataFrame] | None:
    """(reached vertices ``x``, the other edges with the reached part contracted); null without edges."""
    both = both_ways(edges)
    top = both.groupBy("u").count().orderBy(F.desc("count"), "u").limit(1).select(F.col("u").alias("x"))
    reached = frontier = stored(top, "top")
    if not (total := frontier.count()):
        return None
    for _ in range(depth):
        met = both.join(frontier, both["u"] == frontier["x"], "left_semi").select(F.col("v").alias("x")).distinct()
        frontier = stored(met.join(reached, "x", "left_anti"), "frontier")
        size = frontier.count()
        if not size:
            break
        reached, total = reached.union(frontier), total + size
        if size < share * total:
            break
    root = reached.agg(F.min("x")).first()[0]
    inside = reached.select(F.col("x"), F.lit(True).alias("inside"))
    marked = edges.join(inside.select(F.col("x").alias("u"), F.col("inside").alias("in_u")), "u", "left").join(inside.select(F.col("x").alias("v"), F.col("inside").alias("in_v")), "v", "left")
    at = F.lit(root)
    ends = marked.where("in_u is null or in_v is null").select(F.when(F.col("in_u"), at).otherwise(F.col("u")).alias("a"), F.when(F.col("in_v"), at).otherwise(F.col("v")).alias("b"))
    left = ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    return reached.select("x", at.alias("root")), stored(left, "left")


def connected_components(edges: DataFrame, rounds: int = 60, share: float = 0.05, depth: int = 12) -> DataFrame:
    """``id, group_id`` for every vertex of ``edges(u, v)``; group_id is the smallest id of the component.

    Repeated edges, either orientation and self-loops are allowed (a vertex with nothing but self-loops is left out);
    rows with a null end are ignored; no edges give no rows. ``share`` and ``depth`` only decide how far the breadth-first
    part goes before the rest is propagated, not the result.
    """
    edges = stored(link_edges(edges, "u", "v"), "edges")
    peeled = _peel(edges, share, depth)
    if peeled is None:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("group_id"))
    reached, left = peeled
    labels = star_labels(left, rounds)
    giant = reached.join(labels.withColumnRenamed("id", "root"), "root", "left").select(F.col("x").alias("id"), F.coalesce("group_id", "root").alias("group_id"))
    return giant.union(labels.join(reached.select(F.col("x").alias("id")), "id", "left_anti"))
