"""The ledger's fold: accepted requests become nodes, snapshots, versions, conflicts and effects.

State is derived, never updated. A snapshot's requests are independent of other
nodes', so content folds run node by node, in the order of acceptance, as a
stateful stream of rows over partitions sorted by node and sequence: a node's
requests are never gathered, however many there are. What the fold keeps of a node
is the current document and the versions that later requests still name as base.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.merge import InvalidChanges, canonical, merge, overlap
from ledgerloom.functions.scalars import MAX_SNAPSHOT_BYTES

RESULT = "node_id string, event_seq bigint, request_id string, effect string, revision bigint, content_json string, conflicts string, resolves array<string>"


def touches(left: list[str], right: list[str]) -> bool:
    """Whether a change at one path addresses a conflict at the other; an empty path addresses only an empty one."""
    return overlap(tuple(left), tuple(right)) if left and right else not left and not right


def changed_paths(changes: list) -> list[list[str]]:
    """The paths that a change-set writes; an item's has its collection and its id."""
    return [[*(c.get("path") or []), *([c["field"], c["itemId"]] if c["op"] in ("item_set", "item_remove") else [])] for c in changes]


class NodeFold:
    """One snapshot: its current document, its versions by revision and its open conflicts.

    ``needs`` says how many later requests name a version as their base; a version
    that none names any more is dropped. Without it all versions stay.
    """

    def __init__(self, content: str | None = None, revision: int = 0, versions: dict[int, str] | None = None, deleted: bool = False, open_: dict[str, list] | None = None):
        self.content, self.revision, self.deleted = content, revision, deleted
        self.versions, self.open, self.resolves = versions or {}, open_ or {}, []

    def state(self) -> dict:
        return {"content": self.content, "revision": self.revision, "versions": {str(k): v for k, v in self.versions.items()}, "deleted": self.deleted, "open": self.open}

    @classmethod
    def of(cls, state: dict) -> NodeFold:
        return cls(state["content"], state["revision"], {int(k): v for k, v in state["versions"].items()}, state["deleted"], state["open"])

    def apply(self, operation: str, base_revision: int | None, changes: list, request_id: str = "", later: int | None = None) -> tuple[str, list]:
        """(effect, conflicts) of a request; a changed document gets the next revision.

        ``later``: how many requests to come name the revision that this one makes as base; None if that is not known.
        """
        self.resolves = []
        if self.deleted:
            return "cancelled", []
        if operation == "snapshot.delete":
            self.content, self.versions, self.open, self.deleted = None, {}, {}, True
            return "applied", []
        if operation == "conflict.resolve" and self.content is not None and not self.open:
            return "needs_attention", []
        effect, conflicts = self._write(operation, base_revision, changes)
        if effect == "conflict":
            self.open[request_id] = [c["path"] for c in conflicts if c["path"]]
        elif operation == "conflict.resolve" and effect in ("applied", "applied_noop"):
            written = changed_paths(changes)
            self.resolves = sorted(r for r, paths in self.open.items() if any(touches(p, w) for p in paths for w in written))
            for r in self.resolves:
                del self.open[r]
        if effect == "applied" and later == 0:
            self.versions.pop(self.revision, None)
        return effect, conflicts

    def used(self, base_revision: int | None, left: int | None) -> None:
        """A base that ``left`` more requests name."""
        if base_revision is not None and left == 0:
            self.versions.pop(base_revision, None)

    def _write(self, operation: str, base_revision: int | None, changes: list) -> tuple[str, list]:
        if operation == "snapshot.create":
            if self.content is not None:
                return "cancelled", []
            base, current = {}, {}
        else:
            if self.content is None:
                return "cancelled", []
            now = base_revision == self.revision or (operation == "conflict.resolve" and base_revision is None)
            text = self.content if now else self.versions.get(base_revision)
            if text is None:
                return "needs_attention", []
            base, current = json.loads(text), json.loads(self.content)
        try:
            out = merge(base, current, changes) if changes or operation != "snapshot.create" else None
        except InvalidChanges:
            return "needs_attention", []
        if out is not None and out.status != "applied" and operation != "snapshot.create":
            return out.status, out.conflicts
        if out is not None and out.status == "conflict":
            return "conflict", out.conflicts
        text = canonical({} if out is None else out.value)
        if len(text.encode("utf-8")) > MAX_SNAPSHOT_BYTES:
            return "needs_attention", []
        self.content, self.revision = text, self.revision + 1
        self.versions[self.revision] = text
        return "applied", []


def outcome(row: tuple, node: NodeFold, effect: str, conflicts: list) -> tuple:
    """A row of ``RESULT``."""
    written = effect == "applied" and node.content is not None
    return row.node_id, row.event_seq, row.request_id, effect, node.revision, node.content if written else None, canonical(conflicts) if conflicts else None, node.resolves or None


def fold_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of node and sequence to outcomes; state passes from frame to frame.

    Rows of operation ``base`` come before their node's requests: as ``changes`` they have how many requests name the revision.
    """
    node, state, named = None, NodeFold(), None
    for frame in frames:
        out = []
        for row in frame.itertuples(index=False):
            if row.node_id != node:
                node, state, named = row.node_id, NodeFold(), None
            if row.operation == "base":
                named = {} if named is None else named
                named[int(row.base_revision)] = int(row.changes)
                continue
            base = None if pd.isna(row.base_revision) else int(row.base_revision)
            if named is not None and base is not None:
                named[base] = named.get(base, 0) - 1
            later = None if named is None else named.get(state.revision + 1, 0)
            effect, conflicts = state.apply(row.operation, base, json.loads(row.changes) if isinstance(row.changes, str) else [], row.request_id, later)
            if named is not None and base is not None:
                state.used(base, named[base])
            out.append(outcome(row, state, effect, conflicts))
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in RESULT.split(", ")])


def fold_snapshots(requests: DataFrame) -> DataFrame:
    """Outcomes of requests (node_id, event_seq, request_id, operation, base_revision, changes as JSON) in order of acceptance.

    How often each base is named is counted first, so that a task keeps no version longer than it is needed.
    """
    rows = requests.select(F.col("node_id").cast("string"), F.col("event_seq").cast("bigint"), "request_id", "operation", F.col("base_revision").cast("bigint"), "changes")
    counted = rows.where("base_revision IS NOT NULL").groupBy("node_id", "base_revision").agg(F.count("*").alias("n"))
    bases = counted.select("node_id", F.lit(-(2**63)).cast("bigint").alias("event_seq"), F.lit(None).cast("string").alias("request_id"), F.lit("base").alias("operation"), "base_revision", F.col("n").cast("string").alias("changes"))
    return bases.union(rows).repartition("node_id").sortWithinPartitions("node_id", "event_seq").mapInPandas(fold_rows, RESULT)


def snapshots(outcomes: DataFrame) -> DataFrame:
    """The current document of every node."""
    return outcomes.where("content_json IS NOT NULL").groupBy("node_id").agg(F.max_by(F.struct("revision", "content_json"), "event_seq").alias("s")).select("node_id", "s.revision", "s.content_json")


def conflict_rows(outcomes: DataFrame) -> DataFrame:
    """One row a conflict: request, path, reason and both sides."""
    schema = "array<struct<path:array<string>,reason:string,base:string,current:string,proposed:string,parent:string>>"
    rows = outcomes.where("conflicts IS NOT NULL").select("node_id", "event_seq", "request_id", F.posexplode(F.from_json("conflicts", schema)).alias("pos", "c"))
    return rows.select("node_id", "event_seq", "request_id", "pos", F.array_join("c.path", "/").alias("path"), "c.reason", "c.base", "c.current", "c.proposed", "c.parent")


def resolved(conflicts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Conflicts (node_id, conflict_id, event_seq, path array) with the first later resolution (node_id, event_seq, request_id, path array) that touches their path.

    ``resolutions`` are those that were applied. Two paths touch where one is the start of the
    other; an empty path is touched by nothing. Conflicts and resolutions meet on
    the paths they start with, in a window by node and path, so not every conflict
    of a node meets every resolution.
    """
    starts = lambda least: F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - least), lambda n: F.slice("path", F.lit(1), n)))
    whole = F.size("path") > 0
    own = ["node_id", "event_seq"]
    c = conflicts.where(whole).select(*own, "conflict_id", "path")
    r = resolutions.where(whole).select(*own, F.struct("event_seq", F.col("request_id").alias("by")).alias("fix"), "path")
    none = F.lit(None)
    # side 0: the resolution's path is a start of the conflict's; side 1: the conflict's is a shorter start of the resolution's
    rows = (
        c.select(F.lit(0).alias("side"), *own, "conflict_id", none.cast(r.schema["fix"].dataType).alias("fix"), starts(0).alias("at"))
        .union(r.select(F.lit(0), *own, none.cast("string"), "fix", "path"))
        .union(c.select(F.lit(1), *own, "conflict_id", none.cast(r.schema["fix"].dataType), "path"))
        .union(r.where(F.size("path") > 1).select(F.lit(1), *own, none.cast("string"), "fix", starts(1)))
    )
    after = Window.partitionBy("side", "node_id", "at").orderBy("event_seq").rowsBetween(1, Window.unboundedFollowing)
    met = rows.withColumn("fix", F.when(F.col("conflict_id").isNotNull(), F.first("fix", ignorenulls=True).over(after))).where("conflict_id IS NOT NULL")
    first = met.groupBy("conflict_id").agg(F.min("fix").alias("fix")).select("conflict_id", F.col("fix.by").alias("resolved_by"))
    return conflicts.join(first, "conflict_id", "left").withColumn("status", F.when(F.col("resolved_by").isNotNull(), "resolved").otherwise("open"))


def fold_tree(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """The catalogue after structural requests (event_seq, operation, node_id, parent_id, name, kind): the last name, parent and lifecycle of every node.

    Creation comes first; renames and moves are latest-wins columns; a deletion ends a node for good.
    """
    start = nodes.select("node_id", F.lit(0).cast("bigint").alias("event_seq"), F.lit("directory.create").alias("operation"), "parent_id", "name", "kind", "lifecycle")
    steps = start.unionByName(requests.withColumn("lifecycle", F.lit("active")).select(*start.columns))
    is_ = lambda *ops: F.col("operation").isin(*ops)
    create = is_("directory.create", "snapshot.create")
    folded = steps.groupBy("node_id").agg(
        F.max_by("parent_id", F.when(create | is_("directory.move"), F.col("event_seq"))).alias("parent_id"),
        F.max_by("name", F.when(create | is_("directory.rename"), F.col("event_seq"))).alias("name"),
        F.min_by("kind", F.when(create, F.col("event_seq"))).alias("kind"),
        F.min_by("lifecycle", F.when(create, F.col("event_seq"))).alias("first"),
        F.max(is_("directory.delete", "snapshot.delete").cast("int")).alias("ended"),
        F.count_if(is_("directory.move", "directory.rename")).alias("revision"),
    )
    return folded.where("kind IS NOT NULL").select("node_id", "parent_id", "name", "kind", F.when(F.col("ended") == 1, "deleted").otherwise(F.col("first")).alias("lifecycle"), "revision")


def catalog_revisions(requests: DataFrame) -> DataFrame:
    """(event_seq, catalog_revision): how often the catalogue has changed up to each request; content changes do not count.

    Totals of stretches of the sequence come first, so no task sees the whole ledger.
    """
    changes = F.col("operation").isin("directory.create", "directory.rename", "directory.move", "directory.delete", "snapshot.create", "snapshot.delete").cast("bigint")
    rows = requests.select("event_seq", changes.alias("n"), F.floor(F.col("event_seq") / 4096).alias("stretch"))
    totals = rows.groupBy("stretch").agg(F.sum("n").alias("n"))
    before = totals.select("stretch", (F.sum("n").over(Window.orderBy("stretch")) - F.col("n")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("stretch").orderBy("event_seq"))
    return rows.withColumn("inside", inside).join(before, "stretch").select("event_seq", (F.col("before") + F.col("inside")).alias("catalog_revision"))
