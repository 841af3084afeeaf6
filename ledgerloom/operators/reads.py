"""Read operations: pages of a directory, snapshots, history, statuses, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import MAX_PAGE, bytes_of, decode_cursor, display_for, encode_cursor
from ledgerloom.operators.tree import subtree


def clamp(limit: int | None, default: int = 20) -> int:
    """0 and None give the default, negative numbers 1, more than a page a page."""
    return min(max(limit or default, 1), MAX_PAGE)


def capabilities(meta: DataFrame, product: str, protocol: str, version: int) -> DataFrame:
    return meta.select(F.lit(product).alias("product"), F.lit(protocol).alias("protocol"), F.lit(version).alias("api_version"), "workspace_epoch", "catalog_revision")


def children(nodes: DataFrame, parent: str | None, limit: int | None = None, page: int = 0, after: str | None = None) -> DataFrame:
    """A page of active children by name: by offset, or those behind a name (keyset)."""
    size = clamp(limit)
    rows = nodes.where(F.col("parent_id").eqNullSafe(F.lit(parent)) & (F.col("lifecycle") == "active"))
    rows = rows if after is None else rows.where(F.col("name") > after)
    ordered = rows.select("node_id", "name", "kind").orderBy("name")
    return (ordered.offset(page * size) if after is None and page else ordered).limit(size)


def next_cursor(rows: list, limit: int | None, parent: str | None, revision: int) -> str | None:
    """The cursor behind a page of children: given when the page is full, bound to parent and catalog revision."""
    return encode_cursor({"op": "directory.list", "parent": parent, "revision": revision, "after": rows[-1]["name"]}) if len(rows) == clamp(limit) else None


def cursor_after(cursor: str, parent: str | None, revision: int) -> str:
    """The name to go on behind; ``cursor_stale`` where parent or revision are others now."""
    fields = decode_cursor(cursor)
    if fields.get("op") != "directory.list" or fields.get("parent") != parent or fields.get("revision") != revision:
        raise ValueError("cursor_stale")
    return fields["after"]


def query_subtree(nodes: DataFrame, root: str, limit: int | None = 50, after: str | None = None) -> DataFrame:
    """Metadata of a node and all below it that is not deleted, by node id, one row more than the page holds; bodies are not read."""
    inside = nodes.where(F.col("lifecycle") != "deleted").join(subtree(nodes, root), "node_id")
    rows = inside if after is None else inside.where(F.col("node_id") > after)
    return rows.select("node_id", "parent_id", "name", "kind", "lifecycle", "depth").orderBy("node_id").limit(clamp(limit) + 1)


def manifest(nodes: DataFrame, root: str, offset: int, limit: int | None) -> DataFrame:
    """A page of the ids below and with a node that is being deleted."""
    return subtree(nodes, root).select("node_id").orderBy("node_id").offset(offset).limit(clamp(limit))


def latest_snapshots(versions: DataFrame) -> DataFrame:
    return versions.groupBy("node_id").agg(F.max_by(F.struct("revision", "content_json"), "revision").alias("v")).select("node_id", "v.revision", "v.content_json")


def history(versions: DataFrame, node: int | str, limit: int | None = None) -> DataFrame:
    """Versions newest first, with their sizes and without their bodies."""
    return versions.where(F.col("node_id") == node).select("revision", "request_id", bytes_of(F.col("content_json")).alias("bytes")).orderBy(F.desc("revision")).limit(clamp(limit))


def read_snapshots(snapshots: DataFrame, requests: DataFrame, required: DataFrame) -> DataFrame:
    """Snapshots with the effect of a required request (node_id, request_id); stale until it is applied."""
    waiting = F.col("request_id").isNotNull() & ~F.coalesce(F.col("effect").isin("applied", "applied_noop"), F.lit(False))
    return snapshots.join(required, "node_id", "left").join(requests.select("request_id", "effect"), "request_id", "left").select("node_id", "revision", "request_id", "effect", waiting.alias("stale"))


def request_status(requests: DataFrame, ledger: DataFrame, states: DataFrame) -> DataFrame:
    """Requests with their event, dependency state and what a user is told."""
    event = ledger.select("request_id", "operation", "created_at")
    told = display_for(F.lit("cloud_acknowledged"), F.col("effect"), F.col("target_deleted"))
    return requests.drop("operation").join(event, "request_id", "left").join(states, "request_id", "left").select("request_id", "event_seq", "operation", "effect", F.coalesce("dependency", F.lit("ready")).alias("dependency"), told.alias("display"))


def task_status(tasks: DataFrame, ledger: DataFrame) -> DataFrame:
    return tasks.join(ledger.select("event_seq", "operation"), "event_seq", "left").select("task_id", "event_seq", "state", "failure_count", "operation")


def conflicts(rows: DataFrame, node: str | None = None, request: str | None = None, status: str | None = "open") -> DataFrame:
    for name, value in (("node_id", node), ("request_id", request), ("status", status)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows.orderBy("created_at", "conflict_id")


def effect_counts(requests: DataFrame, by: Column) -> DataFrame:
    return requests.groupBy(by.alias("effect")).agg(F.count("*").alias("n"))
