"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, discard


def _toward_min(edges: DataFrame) -> DataFrame:
    """(u, v, m): every edge with the smallest node among u and its neighbours. The minimum is
    merged map-side; the join back splits the partitions of nodes with very many edges."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    return edges.join(low, "u").select("u", "v", F.least("u", "low").alias("m"))


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for undirected edges (u, v) of longs; the component is its smallest
    node. Nodes without edges are not listed. Rounds run until nothing moves; each halves the
    distance to the smallest node, and its table replaces the one before."""
    now = cut_lineage(edges.select(F.col("u").cast("long"), F.col("v").cast("long"))
                      .filter(F.col("u") != F.col("v"))
                      .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours move to the smallest node of the neighbourhood
        large = _toward_min(both).filter(F.col("v") > F.col("u")) \
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its smaller neighbours move to the smallest of them
        moved = cut_lineage(_toward_min(large)
                            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                      F.struct("u", F.col("m").alias("v")))).alias("e"))
                            .select("e.u", "e.v").filter("u != v").distinct())
        discard(now)
        now, state = moved, _state(moved)
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
