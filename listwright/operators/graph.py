"""Connected components by propagating minima along stars.

A round links every vertex and its neighbours to the smallest of them, first the larger neighbours, then the smaller
ones. Paths shrink geometrically, so a chain of n links takes about log n rounds, and each round is two aggregations with
map-side minima and two joins, whatever the skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.runtime import drop_stored, stored


def link_edges(pairs: DataFrame, i: str, j: str) -> DataFrame:
    """Distinct undirected edges ``u < v`` of a pair table; rows with a missing id or equal ids link nothing."""
    ok = F.col(i).isNotNull() & F.col(j).isNotNull() & (F.col(i) != F.col(j))
    return pairs.where(ok).select(F.least(i, j).alias("u"), F.greatest(i, j).alias("v")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in either direction."""
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a vertex to the smallest of the vertex and its neighbours."""
    both = both_ways(edges)
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a vertex and its smaller neighbours to the smallest of them. Edges run u < v."""
    low = edges.groupBy("v").agg(F.min("u").alias("m"))
    met = edges.join(low, "v")
    return met.select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u < v").distinct()


def _mark(edges: DataFrame) -> tuple[int, ...]:
    """Count and order-free checksums; equal marks mean equal edge sets."""
    mix = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(mix % 1_000_003), F.lit(0)), F.coalesce(F.bit_xor(mix), F.lit(0))).first())


def star_labels(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``id, group_id`` of every vertex of distinct edges ``u < v``; group_id is the smallest id of its component.

    Every round writes its edges to the shared folder, which cuts the lineage, and drops those of the round before. No edges give no rows.
    """
    mark = None
    for turn in range(rounds):
        before, edges = edges, stored(_small_star(_large_star(edges)), "stars")
        if turn:
            drop_stored(before)  # nothing reads the table of the last round any more
        if (now := _mark(edges)) == mark:
            tops = edges.select(F.col("u").alias("id"), F.col("u").alias("group_id")).distinct()
            return edges.select(F.col("v").alias("id"), F.col("u").alias("group_id")).union(tops)
        mark = now
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def components(pairs: DataFrame, i: str = "i", j: str = "j", vertices: DataFrame | None = None) -> DataFrame:
    """``id, group_id``; with ``vertices`` (a column ``id``) unlinked vertices form groups of their own."""
    labels = star_labels(stored(link_edges(pairs, i, j), "edges"))
    if vertices is None:
        return labels
    return vertices.select("id").where("id is not null").distinct().join(labels, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))
