"""Bringing an offline replica in line with a deletion manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import MAX_DEPTH
from ledgerloom.operators.tree import members
from ledgerloom.session import cut

PENDING_STATES = ("local_pending", "sending", "waiting_dependency", "delivery_blocked")


def plan(manifest: DataFrame, replica: DataFrame) -> DataFrame:
    """(node_id, action) of every local node: erase, conflict, or keep.

    Nodes of the manifest go. From them a walk down the local tree erases children
    as well, but stops at a node that moved out before the gate, and marks a node
    that moved in after it, with all below it, as a conflict.
    """
    local = replica.select("node_id", "parent_id", F.coalesce("moved_out", F.lit(False)).alias("out"), F.coalesce("moved_in", F.lit(False)).alias("in"))
    listed = manifest.select("node_id").distinct()
    seed = listed.select("node_id", F.lit("erase").alias("action"))
    level, out = seed, seed
    children = local.join(listed, "node_id", "left_anti")
    for _ in range(MAX_DEPTH + 1):
        found = children.join(level.select(F.col("node_id").alias("parent_id"), F.col("action").alias("above")), "parent_id")
        action = F.when(F.col("above") == "conflict", "conflict").when(F.col("out"), "keep").when(F.col("in"), "conflict").otherwise("erase")
        level = found.select("node_id", action.alias("action")).where("action <> 'keep'")
        level = cut(level)
        if level.isEmpty():
            break
        out = out.union(level)
    decided = out.groupBy("node_id").agg(F.max("action").alias("action"))
    kept = local.select("node_id").join(decided, "node_id", "left_anti").select("node_id", F.lit("keep").alias("action"))
    return decided.union(kept)


def cancellations(actions: DataFrame, pending: DataFrame) -> DataFrame:
    """Pending requests (request_id, node_id, parent_id, state) whose node or parent is erased."""
    erased = actions.where("action = 'erase'").select("node_id")
    open_ = pending.where(F.col("state").isin(*PENDING_STATES))
    own = open_.join(erased, "node_id", "left_semi").select("request_id", F.lit("node_erased").alias("reason"))
    parent = open_.join(erased.withColumnRenamed("node_id", "parent_id"), "parent_id", "left_semi").select("request_id", F.lit("parent_erased").alias("reason"))
    return own.union(parent).groupBy("request_id").agg(F.min("reason").alias("reason"))


def apply(actions: DataFrame, replica: DataFrame, audit: DataFrame, kind: str = "erase") -> tuple[DataFrame, DataFrame]:
    """(the replica without erased nodes, the audit rows that are new); a second run changes nothing."""
    erased = actions.where("action = 'erase'").select("node_id")
    gone = replica.join(erased, "node_id", "left_semi").select(F.concat_ws(":", F.lit(kind), "node_id").alias("audit_id"), "node_id")
    return replica.join(erased, "node_id", "left_anti"), gone.join(audit.select("audit_id"), "audit_id", "left_anti")


def tombstones(requests: DataFrame) -> DataFrame:
    """Requests without their bodies: identity, operation and target stay."""
    return requests.select("request_id", "operation", "node_id", F.lit(True).alias("body_redacted"))


def cancel_by_node(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """(request_id, outcome): what a cancellation of all requests on the nodes, or below them, does."""
    slim = requests.select("request_id", "node_id", "parent_id", "state")
    own = slim.join(nodes.select("node_id"), "node_id", "left_semi")
    below = slim.join(nodes.select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi")
    hit = own.unionByName(below).distinct()
    outcome = F.when(F.col("state") == "cancelled", "already_cancelled").when(F.col("state") == "cloud_acknowledged", "acknowledged").otherwise("cancelled")
    return hit.select("request_id", outcome.alias("outcome"))


def directory_delete(deletes: DataFrame, nodes: DataFrame, events: DataFrame, tasks: DataFrame, requests: DataFrame) -> DataFrame:
    """(kind, id, action): what finished deletions (node_id, request_id) do to the tables.

    The node itself ends, one that was never there leaves a tombstone; nodes below it stay,
    without their contents. Events (request_id, event_seq, node_id, target_parent_id) of the subtree other than the deletion
    lose their bodies, their open tasks (event_seq, state) and pending requests (request_id, effect) are cancelled.
    """
    inside = cut(members(nodes, deletes).select("node_id", F.col("root")))
    there = deletes.select("node_id").distinct().join(nodes.select("node_id", F.lit(True).alias("known")), "node_id", "left")
    ended = there.select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), F.when(F.col("known"), "deleted").otherwise("tombstone").alias("action"))
    bodies = nodes.where("kind = 'snapshot'").join(inside, "node_id", "left_semi").select(F.lit("snapshot").alias("kind"), F.col("node_id").alias("id"), F.lit("removed").alias("action"))
    # A node may lie below two deletions; an event is spared by its own deletion only.
    by = inside.join(deletes.select(F.col("node_id").alias("root"), F.col("request_id").alias("by")), "root").select("node_id", "by")
    hit = lambda c: events.join(by.withColumnRenamed("node_id", c), c).where("by <> request_id").select("request_id", "event_seq")
    hits = cut(hit("node_id").union(hit("target_parent_id")).distinct())
    redacted = hits.select(F.lit("event").alias("kind"), F.col("request_id").alias("id"), F.lit("redacted").alias("action"))
    stopped = tasks.where(F.col("state").isin("pending", "queued", "processing")).join(hits, "event_seq", "left_semi").select(F.lit("task").alias("kind"), F.col("task_id").alias("id"), F.lit("cancelled").alias("action"))
    closed = requests.where("effect = 'pending'").join(hits, "request_id", "left_semi").select(F.lit("request").alias("kind"), F.col("request_id").alias("id"), F.lit("cancelled").alias("action"))
    return ended.union(bodies).union(redacted).union(stopped).union(closed)
