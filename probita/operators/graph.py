"""Ownership graphs: roots, descendants within a depth, screening along the chain.

Edges run from owner to owned. All walks are joins of a frontier with the edge table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probita.functions.scalars import known
from probita.operators import matching
from probita.session import cut_lineage

MAX_DEPTH = 5


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """First node of each structure that nobody owns (``position`` is the order in the file)."""
    owned = edges.select("structure", F.col("owned_id").alias("entity_id")).distinct()
    # Never broadcast: the engine sizes edges by the compressed files that they come from.
    free = nodes.join(owned.hint("merge"), ["structure", "entity_id"], "left_anti")
    return free.groupBy("structure").agg(F.min_by("entity_id", F.struct("position", "entity_id")).alias("root_id"))


def descendants(starts: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Nodes below each start within ``max_depth`` steps, with the shortest path (the smallest one on a tie).

    ``starts`` has ``structure`` and ``root_id``. A round joins the edges with the nodes that the round before found, and keeps those
    that no round has found, so every node is expanded once for each root and a cycle ends where it closes. Rounds are written out: a later one
    reads what earlier ones found and plans none of it again. An owner of very many is split by the engine's skew join.
    """
    steps = cut_lineage(edges.select("structure", "owner_id", "owned_id").distinct())
    begun = starts.select("structure", "root_id", F.col("root_id").alias("node_id")).distinct()
    level = cut_lineage(begun.select("*", F.lit(0).alias("depth"), F.array("root_id").alias("path")))
    seen = level
    for depth in range(1, max_depth + 1):
        grown = level.withColumnRenamed("node_id", "owner_id").join(steps, ["structure", "owner_id"]).select(
            "structure", "root_id", F.col("owned_id").alias("node_id"), F.concat("path", F.array("owned_id")).alias("path"))
        new = grown.join(seen.select("structure", "root_id", "node_id"), ["structure", "root_id", "node_id"], "left_anti")
        level = cut_lineage(new.groupBy("structure", "root_id", "node_id").agg(F.lit(depth).alias("depth"), F.min("path").alias("path")))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen.where("depth > 0")


def count_descendants(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """All nodes below each start, whatever the depth.

    Rounds go on until none finds a new node. Each is written out, so that neither the plan nor the
    work to repeat after a lost executor grows with the depth. No join is broadcast, so that what passes through the driver does
    not grow with edges, nodes or rounds; the engine sizes edges by the compressed files that they come from.
    """
    steps = cut_lineage(edges.select("structure", "owner_id", "owned_id").distinct())
    frontier = cut_lineage(starts.select("structure", "root_id", F.col("root_id").alias("node_id")).distinct())
    seen = frontier
    while True:
        reached = frontier.withColumnRenamed("node_id", "owner_id").hint("merge").join(steps.hint("merge"), ["structure", "owner_id"]).select(
            "structure", "root_id", F.col("owned_id").alias("node_id")).distinct()
        frontier = cut_lineage(reached.hint("merge").join(seen.hint("merge"), ["structure", "root_id", "node_id"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(frontier))
    return seen.groupBy("structure", "root_id").agg((F.count(F.lit(1)) - 1).alias("nodes_traversed"))


def node_queries(nodes: DataFrame) -> DataFrame:
    """Screening queries of graph nodes: birth date, nationality and company come out of the metadata."""
    def lifted(name: str) -> Column:
        from_metadata = known(F.try_element_at("metadata", F.lit(name)))
        return F.coalesce(known(name), from_metadata) if name in nodes.columns else from_metadata
    return nodes.select(
        "structure", F.col("entity_id").alias("node_id"), F.col("entity_id"),
        F.coalesce("name", "entity_id").alias("name"), "context", *[lifted(f).alias(f) for f in ("dob", "nationality", "company")])


def sanctioned_in_chain(nodes: DataFrame, edges: DataFrame, watchlist: DataFrame, starts: DataFrame | None = None,
                        max_depth: int = MAX_DEPTH) -> DataFrame:
    """Best match of every node below the root, with the ownership path that leads to it."""
    starts = roots(nodes, edges) if starts is None else starts
    below = cut_lineage(descendants(starts, edges, max_depth))  # screening reads it several times
    wanted = node_queries(nodes).join(below.select("structure", "node_id").distinct(), ["structure", "node_id"], "left_semi")
    asked = cut_lineage(wanted.withColumn("entity_id", F.to_json(F.struct("structure", "node_id"))).drop("structure", "node_id"))
    best = matching.screen(asked, watchlist, 1)
    key = F.from_json("entity_id", "structure string, node_id string")
    matched = best.withColumn("k", key).select(F.col("k.structure").alias("structure"), F.col("k.node_id").alias("node_id"),
                                               "matched_against", "candidate_name", "source", "match_score", "classification")
    return below.join(matched, ["structure", "node_id"])
