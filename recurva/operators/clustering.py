"""Entity clusters: connected components of the matching pairs.

Components come from alternating large-star and small-star steps (Kiveris et al. 2014). Each step is an
aggregate for the smallest neighbour and a join back, so no neighbour list is ever collected. A node with very many
edges is heavy: its smallest neighbour, found by an aggregate that combines before its shuffle, is sent to all tasks, and its
edges are moved where they lie. Only the edges of light nodes are shuffled to their node. The limit grows with the edges, so
that heavy nodes are always few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurva.session import checkpointed

#: Edges from which on a node may be heavy, and how many heavy nodes there can be at most.
HEAVY_EDGES = 4096
HEAVY_NODES = 50_000


def _with_smallest(edges: DataFrame, total: int, heavy_edges: int) -> tuple[DataFrame, DataFrame]:
    """Edges with the smallest `v` of their `u`, and a row `u, smallest` per node. `total` is the number of edges.

    Nodes of more than `heavy_edges` edges, and of more than a `HEAVY_NODES`-th of all, are heavy: fewer than `HEAVY_NODES`.
    """
    low = edges.groupBy("u").agg(F.min("v").alias("smallest"), F.count(F.lit(1)).alias("edges"))
    limit = max(heavy_edges, total // HEAVY_NODES)
    if total <= limit:
        return edges.join(low.drop("edges"), "u"), low.drop("edges")
    low = checkpointed(low)
    heavy = low.where(F.col("edges") > limit)
    if heavy.isEmpty():
        return edges.join(low.drop("edges"), "u"), low.drop("edges")
    heavy = F.broadcast(heavy.select("u", F.col("smallest").alias("known")))
    marked = edges.join(heavy, "u", "left")
    light = marked.where("known IS NULL").drop("known").join(low.where(F.col("edges") <= limit).drop("edges"), "u")
    return light.unionByName(marked.where("known IS NOT NULL").withColumnRenamed("known", "smallest")), low.drop("edges")


def _large_star(edges: DataFrame, total: int, heavy_edges: int) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    met, _ = _with_smallest(both, 2 * total, heavy_edges)
    return met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "smallest").alias("v"))


def _small_star(edges: DataFrame, total: int, heavy_edges: int) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    met, low = _with_smallest(edges, total, heavy_edges)
    moved = met.where(F.col("v") != F.col("smallest")).select(F.col("v").alias("u"), F.col("smallest").alias("v"))
    return moved.unionByName(low.withColumnRenamed("smallest", "v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges form stars: every node points to one centre, and centres point nowhere."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("points")).unionAll(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("points")))
    seen = ends.groupBy("node").agg(F.sum("points").alias("points"), F.min("points").alias("centre"))
    return seen.where((F.col("points") > 1) | ((F.col("points") > 0) & (F.col("centre") == 0))).isEmpty()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 100, heavy_edges: int = HEAVY_EDGES) -> DataFrame:
    """`node, cluster_id` for every node with an edge; the cluster is named after its smallest node."""
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    stars = checkpointed(edges.select(u, v).where(F.col("u") != F.col("v")).distinct())
    total = stars.count()
    for _ in range(max_rounds):
        moved = _large_star(stars, total, heavy_edges)
        if 2 * total > heavy_edges:
            moved = checkpointed(moved)  # read twice where heavy nodes are looked for
        stars = checkpointed(_small_star(moved, total, heavy_edges))
        total = stars.count()
        if _settled(stars):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = stars.select(F.col("u").alias("node"), F.col("v").alias("cluster_id"))
    return members.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("cluster_id")).distinct())


def cluster_confidence(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """Highest and mean score of all pairs of a cluster; a pair counts once per copy on either side.

    Pairs may carry the cluster of their side `a` as `a_cluster_id`; then they go straight into the aggregate.
    """
    if "a_cluster_id" not in pairs.columns:
        placed = components.select(F.col("node").alias("a_node"), F.col("cluster_id").alias("a_cluster_id"))
        pairs = pairs.join(placed, "a_node")
    weight = F.col("a_copies") * F.col("b_copies")
    return pairs.groupBy(F.col("a_cluster_id").alias("cluster_id")).agg(
        F.max("total_score").alias("max_confidence"),
        (F.sum(F.col("total_score") * weight) / F.sum(weight)).alias("avg_confidence"),
        F.sum(weight).alias("pairs"),
    )


def cluster_members(profiles: DataFrame, nodes: DataFrame, components: DataFrame) -> DataFrame:
    """`cluster_id, source_type, record_id` for every record, copies included, that belongs to a cluster."""
    placed = nodes.select("node", "source_type", "profile").join(components, "node")
    return profiles.select("source_type", "record_id", "profile").join(
        placed.select("source_type", "profile", "cluster_id"), ["source_type", "profile"]
    ).select("cluster_id", "source_type", "record_id")
