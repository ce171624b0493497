"""Bounded traversal and full reachability."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans import kept


@dataclass
class Traversal:
    nodes: DataFrame  # stable_key, depth and the entity's columns
    edges: DataFrame
    truncated: bool
    missing: list[str]


def traverse(
    entities: DataFrame,
    relationships: DataFrame,
    start: Sequence[str],
    *,
    mode: str = "neighborhood",
    direction: str | None = None,
    kinds: Sequence[str] = (),
    max_depth: int = 3,
    max_nodes: int = 200,
) -> Traversal:
    """The neighbourhood of `start`, level by level, in order of (depth, stable_key).

    At most 1,000 keys are ever held by the driver: each level filters relationships by them, which the scan sees as
    a pushed-down IN, and takes the first new neighbours that still fit.
    """
    if not 0 <= max_depth <= 10 or not 1 <= max_nodes <= 1000 or not start:
        raise ValueError("max_depth is 0 to 10, max_nodes 1 to 1000, and there is a start")
    direction = direction or ("outgoing" if mode == "endpoint-flow" else "both")
    rels = relationships.where(F.col("kind").isin(*kinds)) if kinds else relationships
    there = {r["stable_key"] for r in entities.where(F.col("stable_key").isin(*start)).select("stable_key").distinct().collect()}
    missing = [k for k in dict.fromkeys(start) if k not in there]
    roots = sorted(there)
    truncated = len(roots) > max_nodes
    depth_of = dict.fromkeys(roots[:max_nodes], 0)
    frontier, edge_ids = list(depth_of), None
    for depth in range(1, max_depth + 1):
        if truncated or not frontier:
            break
        from_here = F.col("source_key").isin(*frontier)
        to_here = F.col("target_key").isin(*frontier)
        touched = rels.where({"outgoing": from_here, "incoming": to_here, "both": from_here | to_here}[direction])
        # one scan gives the far ends on both sides
        ends = [F.when(from_here, F.col("target_key"))] * (direction != "incoming") + [F.when(to_here, F.col("source_key"))] * (direction != "outgoing")
        reached = touched.select(F.explode(F.array_compact(F.array(*ends))).alias("stable_key"))
        room = max_nodes - len(depth_of)
        fresh = reached.where(~F.col("stable_key").isin(*depth_of)).distinct().join(entities.select("stable_key"), "stable_key", "left_semi")
        found = [r["stable_key"] for r in fresh.orderBy("stable_key").limit(room + 1).collect()]
        truncated, found = len(found) > room, found[:room]
        depth_of |= dict.fromkeys(found, depth)
        both = F.col("source_key").isin(*depth_of) & F.col("target_key").isin(*depth_of)
        edges = touched.where(both)
        edge_ids = edges if edge_ids is None else edge_ids.union(edges)
        frontier = found
    spark = entities.sparkSession
    depths = spark.createDataFrame(sorted(depth_of.items()), "stable_key string, depth int")
    nodes = entities.join(F.broadcast(depths), "stable_key")  # at most 1,000 rows
    edges = edge_ids.dropDuplicates(["id"]) if edge_ids is not None else relationships.where(F.lit(False))
    return Traversal(nodes, edges, truncated, missing)


def reachable(relationships: DataFrame, start: DataFrame, max_depth: int | None = None, merge_every: int = 8) -> DataFrame:
    """stable_key and least depth of everything that outgoing edges reach from start(stable_key), at most max_depth
    steps away if that is given; else the levels go on until one reaches nothing new, which also ends cycles.

    Frontiers and what was visited are tables: nothing is collected, whatever the graph's size. Every merge_every levels
    the visited ones become one table, so a deep graph doesn't read a table for each level.
    """
    edges = kept(relationships.select("source_key", "target_key").distinct())
    visited = frontier = kept(start.select("stable_key", F.lit(0).alias("depth")).distinct())
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(edges, frontier["stable_key"] == edges["source_key"]).select(F.col("target_key").alias("stable_key")).distinct()
        frontier = kept(step.join(visited, "stable_key", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        visited = visited.union(frontier)
        if depth % merge_every == 0:
            visited = kept(visited)
    return visited
