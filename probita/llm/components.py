"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probita.session import cut_lineage, released


def _rewired(edges: DataFrame, small: bool) -> DataFrame:
    """One star step. ``edges`` has ``u`` > ``v``; so has the result.

    Large: every node hands its larger neighbours to its smallest neighbour (or itself).
    Small: every node hands its smaller neighbours, and itself, to the smallest of them.
    """
    if small:
        sides = edges
    else:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = sides.groupBy("u").agg(F.min("v").alias("m"))
    joined = sides.join(least, "u")
    if small:
        new = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    else:
        new = joined.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    return new.where("u > v").distinct()


def _mark(edges: DataFrame) -> tuple:
    sums = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")))
    return tuple(released(sums).collect()[0])


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node of its component) for every node that has an edge and is not the root itself.

    ``edges`` has two long columns ``u`` and ``v``; loops and repeated edges are allowed, rows with a NULL end are
    ignored. A step shuffles no more rows than there are edges; a node with very many neighbours is split by the
    engine's skew join, its minimum is formed per task first. Every round ends in a checkpoint, so a lost executor
    repeats one round at most. Rounds go on until nothing changes, which takes a logarithmic number of them.
    """
    held = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u > v").distinct())
    mark = _mark(held)
    while mark[0]:
        held = cut_lineage(_rewired(_rewired(held, small=False), small=True))
        was, mark = mark, _mark(held)
        if was == mark:
            break
    return held.select(F.col("u").alias("node"), F.col("v").alias("root"))
