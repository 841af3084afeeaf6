"""Operators on the tree of nodes (node_id, parent_id, name, kind, lifecycle).

A node's chain of ancestors is a recursive CTE, of at most ``MAX_DEPTH`` rows. All else goes level
by level: one equi-join a level, at most ``MAX_DEPTH`` of them and the root, and no
row limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import MAX_DEPTH
from ledgerloom.session import cut


def _sql(text: str, **frames: DataFrame) -> DataFrame:
    return next(iter(frames.values())).sparkSession.sql(text, **frames)


def members(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node_id, depth) of every root (node_id) that is there and of all below it."""
    slim = nodes.select("node_id", "parent_id")
    level = slim.join(roots.select("node_id").distinct(), "node_id", "left_semi").select(F.col("node_id").alias("root"), "node_id", F.lit(0).alias("depth"))
    out = level
    for depth in range(1, MAX_DEPTH + 1):
        level = cut(slim.join(level.select("root", F.col("node_id").alias("parent_id")), "parent_id").select("root", "node_id", F.lit(depth).alias("depth")))
        if level.isEmpty():
            break
        out = out.union(level)
    return out


def subtree(nodes: DataFrame, root: str) -> DataFrame:
    """(node_id, depth) of a node and all below it."""
    return members(nodes, nodes.where(F.col("node_id") == root)).select("node_id", "depth")


def ancestors_of(nodes: DataFrame, node: str) -> DataFrame:
    """(node_id, distance) from a node up to its root, itself at 0."""
    slim = nodes.select("node_id", "parent_id")
    return _sql(
        f"""WITH RECURSIVE up(node_id, parent_id, distance) MAX RECURSION LEVEL {MAX_DEPTH + 1} AS (
              SELECT node_id, parent_id, 0 FROM {{slim}} WHERE node_id = '{node.replace("'", "''")}'
              UNION ALL SELECT n.node_id, n.parent_id, u.distance + 1 FROM up u JOIN {{slim}} n ON n.node_id = u.parent_id)
            SELECT node_id, distance FROM up""",
        slim=slim,
    )


def closure(nodes: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(node_id, ancestor_id, distance) of every node (or of ``starts``) and each of its ancestors, itself at 0."""
    slim = nodes.select("node_id", "parent_id")
    first = slim if starts is None else slim.join(starts.select("node_id"), "node_id", "left_semi")
    level = first.select("node_id", F.col("node_id").alias("ancestor_id"), F.col("parent_id").alias("next"), F.lit(0).alias("distance"))
    out = level.drop("next")
    up = slim.select(F.col("node_id").alias("next"), F.col("parent_id").alias("above"))
    for distance in range(1, MAX_DEPTH + 1):
        level = level.where("next IS NOT NULL").join(up, "next").select("node_id", F.col("next").alias("ancestor_id"), F.col("above").alias("next"), F.lit(distance).alias("distance"))
        level = cut(level)
        if level.isEmpty():
            break
        out = out.union(level.drop("next"))
    return out


def paths(nodes: DataFrame) -> DataFrame:
    """(node_id, path, depth): names from the root down, over active nodes whose ancestors are all active."""
    active = nodes.where(F.col("lifecycle") == "active").select("node_id", "parent_id", "name")
    level = active.where("parent_id IS NULL").select("node_id", F.array("name").alias("names"))
    out = level
    for _ in range(MAX_DEPTH):
        level = active.join(level.withColumnRenamed("node_id", "parent_id"), "parent_id").select("node_id", F.concat("names", F.array("name")).alias("names"))
        level = cut(level)
        if level.isEmpty():
            break
        out = out.union(level)
    return out.select("node_id", F.array_join("names", "/").alias("path"), F.size("names").alias("depth"))


def resolve(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, node_id, kind, matches) of every wanted path; the empty path is the root; a path with several matches gets no node."""
    hits = wanted.join(paths(nodes).select("path", "node_id"), "path", "left").groupBy("path").agg(F.count("node_id").alias("matches"), F.min("node_id").alias("node_id"))
    named = hits.withColumn("node_id", F.when(F.col("matches") == 1, F.col("node_id"))).join(nodes.select("node_id", "kind"), "node_id", "left")
    return named.select("path", "node_id", F.when(F.col("path") == "", "root").otherwise(F.col("kind")).alias("kind"), "matches")


def blocked(nodes: DataFrame, gates: DataFrame) -> DataFrame:
    """(node_id, blocked_by, distance): the nearest ancestor-or-self that is gated or not active, of the nodes that have one."""
    stops = cut(nodes.where(F.col("lifecycle") != "active").select("node_id").union(gates.select("node_id")).distinct().join(nodes.select("node_id"), "node_id", "left_semi"))
    free = nodes.select("node_id", "parent_id").join(stops, "node_id", "left_anti")
    # From the stops down: a node that is none itself has its parent's nearest stop, so each is reached once.
    level = stops.select("node_id", F.col("node_id").alias("blocked_by"), F.lit(0).alias("distance"))
    out = level
    for distance in range(1, MAX_DEPTH + 1):
        level = cut(free.join(level.select(F.col("node_id").alias("parent_id"), "blocked_by"), "parent_id").select("node_id", "blocked_by", F.lit(distance).alias("distance")))
        if level.isEmpty():
            break
        out = out.union(level)
    return out


def move_cycles(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """The moves (node_id, new_parent_id) with ``cycle``: whether the new parent is the node or below it."""
    up = closure(nodes, moves.select(F.col("new_parent_id").alias("node_id")).distinct()).select(F.col("node_id").alias("new_parent_id"), F.col("ancestor_id").alias("node_id")).withColumn("cycle", F.lit(True))
    return moves.join(up, ["node_id", "new_parent_id"], "left").withColumn("cycle", F.coalesce("cycle", F.lit(False)))


def sibling_collisions(nodes: DataFrame) -> DataFrame:
    """(parent_id, name, n): names that several siblings hold; one being deleted still holds its name, a deleted one does not."""
    return nodes.where((F.col("lifecycle") != "deleted") & F.col("name").isNotNull()).groupBy("parent_id", "name").agg(F.count("*").alias("n")).where("n > 1")


def name_taken(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted (parent_id, name, except_id) that a sibling other than ``except_id`` holds already."""
    held = nodes.where(F.col("lifecycle") != "deleted").select("parent_id", "name", "node_id")
    match = wanted["parent_id"].eqNullSafe(held["parent_id"]) & (wanted["name"] == held["name"]) & ~held["node_id"].eqNullSafe(wanted["except_id"])
    return wanted.join(held, match, "left_semi")
