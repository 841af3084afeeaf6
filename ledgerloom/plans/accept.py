"""Accepting requests: structural and semantic validation, each failure a stable code, then what the acceptance enqueues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import EPOCH, MAX_CHANGES, MAX_REQUEST_BYTES, REQUEST_ID, derived_id, name_problem, path_problem
from ledgerloom.operators.tree import blocked, closure, move_cycles
from ledgerloom.session import cut

# The operations.
READS = ("capabilities", "directory.list", "directory.resolve", "snapshot.read", "snapshot.query", "snapshot.history", "request.status", "conflict.list", "task.status", "deletion.manifest")
WRITES = ("directory.create", "directory.rename", "directory.move", "directory.delete", "snapshot.create", "snapshot.patch", "snapshot.delete", "conflict.resolve", "task.retry")
PROJECTED = tuple(o for o in WRITES if o != "task.retry")
MAX_DEPENDENCIES = 32
MAX_REPLACES = 8


def _any(array: Column, test) -> Column:
    return F.coalesce(F.exists(array, test), F.lit(False))


def change_problem(change: Column) -> Column:
    """Whether a change is malformed."""
    item = change["op"].isin("item_set", "item_remove")
    no_item = item & (F.coalesce(change["field"], F.lit("")).eqNullSafe("") | F.coalesce(change["itemId"], F.lit("")).eqNullSafe(""))
    no_value = change["op"].isin("set", "item_set") & change["value"].isNull()
    known = F.coalesce(change["op"].isin("set", "remove", "item_set", "item_remove"), F.lit(False))
    return ~known | F.coalesce(no_item, F.lit(False)) | F.coalesce(no_value, F.lit(False)) | (change["path"].isNotNull() & path_problem(change["path"]).isNotNull())


def envelope_code(protocol: str, version: int) -> Column:
    """Why an envelope (see ``sources.tables.ENVELOPE``) is refused; null if it is well formed."""
    c = F.col
    target = c("target")
    return (
        F.when(c("requestId").isNull() & c("operation").isNull() & c("protocol").isNull(), "invalid_request")
        .when(~c("protocol").eqNullSafe(protocol), "unsupported_protocol")
        .when(~c("apiVersion").eqNullSafe(version), "unsupported_api_version")
        .when(~F.coalesce(c("workspaceEpoch").rlike(EPOCH), F.lit(False)), "invalid_workspace_epoch")
        .when(~F.coalesce(c("requestId").rlike(REQUEST_ID), F.lit(False)), "invalid_request_id")
        .when(~F.coalesce(c("operation").isin(*READS, *WRITES), F.lit(False)), "unsupported_operation")
        .when(target["path"].isNotNull() & (path_problem(target["path"]) == "depth"), "invalid_path")
        .when(target["path"].isNotNull() & path_problem(target["path"]).isNotNull(), "invalid_name")
        .when(target["name"].isNotNull() & name_problem(target["name"]).isNotNull(), "invalid_name")
        .when(c("dependsOn").isNotNull() & (F.size("dependsOn") > MAX_DEPENDENCIES), "invalid_dependencies")
        .when(_any(c("dependsOn"), lambda r: r.isNull() | ~r.rlike(REQUEST_ID)), "invalid_request_id")
        .when(c("replaces").isNotNull() & (F.size("replaces") > MAX_REPLACES), "invalid_replaces")
        .when(_any(c("replaces"), lambda r: r.isNull() | ~r.rlike(REQUEST_ID)), "invalid_request_id")
        .when(_any(c("replaces"), lambda r: r == c("requestId")), "invalid_replaces")
        .when(c("baseRevision") < 0, "invalid_base_revision")
        .when(c("changes").isNotNull() & (F.size("changes") > MAX_CHANGES), "invalid_changes")
        .when(_any(c("changes"), change_problem), "invalid_change")
        .when(F.octet_length(F.to_json(F.struct("workspaceEpoch", "requestId", "operation", "target", "dependsOn", "baseRevision", "changes", "confirmation", "replaces"))) > MAX_REQUEST_BYTES, "request_too_large")
    )


def _meet(rows: DataFrame, facts: DataFrame, *keys: str) -> DataFrame:
    """A left join on ``keys``. Rows with a null key meet nothing; they are spread over the tasks by their first column."""
    void = F.lit(False)
    for k in keys:
        void = void | F.col(k).isNull()
    rows = rows.withColumn("_salt", F.when(void, F.pmod(F.xxhash64(rows.columns[0]), F.lit(1024))).otherwise(F.lit(0).cast("bigint")))
    # 0 of every row that has its keys, but not a literal, so that it stays a key.
    facts = facts.withColumn("_salt", F.least(F.length(keys[0]), F.lit(0)).cast("bigint"))
    return rows.join(facts, [*keys, "_salt"], "left").drop("_salt")


def target_codes(requests: DataFrame, nodes: DataFrame, stopped: DataFrame) -> DataFrame:
    """Requests (request_id, operation, node_id, parent_id, name) with the ``code`` that refuses them against the tree, or null.

    ``stopped`` has the nodes under a gate or a node that is not active, with the ``distance`` to it.
    """
    about = nodes.select("node_id", "kind", "lifecycle", "parent_id", "name").join(stopped.select("node_id", "distance"), "node_id", "left")
    state = about.select("node_id", F.col("kind").alias("node_kind"), F.col("lifecycle").alias("node_state"), F.col("parent_id").alias("node_parent"), F.col("name").alias("own_name"), F.col("distance").isNotNull().alias("node_blocked"))
    parent = about.select(F.col("node_id").alias("parent_id"), F.col("kind").alias("parent_kind"), F.col("lifecycle").alias("parent_state"), F.col("distance").isNotNull().alias("parent_blocked"), (F.col("distance") == 0).alias("parent_gated"))
    moves = requests.where("operation = 'directory.move'").select("node_id", F.col("parent_id").alias("new_parent_id")).distinct()
    loops = move_cycles(nodes, moves).where("cycle").select("node_id", F.col("new_parent_id").alias("parent_id"), F.lit(True).alias("loops"))
    held = nodes.where("lifecycle <> 'deleted'").groupBy(F.coalesce("parent_id", F.lit("")).alias("held_parent"), F.col("name").alias("held_name")).agg(F.min("node_id").alias("holder"), F.count("*").alias("holders"))
    first, *_ = requests.columns
    wide = requests
    for facts, keys in ((state, ["node_id"]), (parent, ["parent_id"]), (loops, ["node_id", "parent_id"])):
        wide = _meet(wide.select(first, *(n for n in wide.columns if n != first)), facts, *keys)
    op = F.col("operation")
    under = F.when(op == "directory.rename", F.col("node_parent")).otherwise(F.col("parent_id"))
    wide = wide.withColumn("wanted", F.when(op == "directory.move", F.col("own_name")).otherwise(F.col("name"))).withColumn("under", F.coalesce(under, F.lit("")))
    held = held.withColumnsRenamed({"held_parent": "under", "held_name": "wanted"})
    wide = _meet(wide.select(first, *(n for n in wide.columns if n != first)), held, "under", "wanted")
    creates = op.isin("directory.create", "snapshot.create")
    snapshot_op = op.isin("snapshot.patch", "snapshot.delete", "conflict.resolve")
    taken = F.col("holder").isNotNull() & ~(F.col("holder").eqNullSafe(F.col("node_id")) & (F.col("holders") == 1))
    code = (
        F.when(creates & F.col("parent_id").isNotNull() & F.col("parent_state").isNull(), "target_not_found")
        .when(creates & ((F.col("parent_state") != "active") | F.coalesce("parent_blocked", F.lit(False))), "target_deleted")
        .when(creates & (F.col("parent_kind") == "snapshot"), "invalid_target")
        .when(creates & (op == "snapshot.create") & F.col("parent_id").isNull(), "invalid_target")
        .when(creates & taken, "name_conflict")
        .when(creates & (F.col("node_state") == "deleted"), "target_deleted")
        .when(creates & F.col("node_state").isNotNull(), "target_exists")
        .when(~creates & F.col("node_state").isNull() & (op != "directory.delete"), "target_not_found")
        .when(~creates & ((F.col("node_state") != "active") | F.coalesce("node_blocked", F.lit(False))), "target_deleted")
        .when(snapshot_op & (F.col("node_kind") != "snapshot"), "invalid_target")
        .when(op.startswith("directory.") & ~creates & (F.col("node_kind") == "snapshot"), "invalid_target")
        .when((op == "directory.move") & (F.col("node_kind") == "domain"), "invalid_target")
        .when((op == "directory.move") & F.col("node_id").eqNullSafe(F.col("parent_id")), "invalid_target")
        .when((op == "directory.move") & F.col("parent_id").isNotNull() & ~(F.col("parent_state").eqNullSafe("active")), "target_not_found")
        .when((op == "directory.move") & (F.col("parent_kind") == "snapshot"), "invalid_target")
        .when((op == "directory.move") & F.col("parent_gated"), "target_deleted")
        .when((op == "directory.move") & F.col("loops"), "invalid_target")
        .when(op.isin("directory.rename", "directory.move") & taken, "name_conflict")
    )
    return wide.select(*requests.columns, code.alias("code"))


def replacements(requests: DataFrame, effects: DataFrame) -> DataFrame:
    """Per request that replaces others (request_id, replaces): how many it names and how many of them are still pending and replaceable."""
    each = requests.select("request_id", F.explode("replaces").alias("old"))
    ok = effects.where("effect = 'pending' AND operation NOT IN ('directory.delete', 'conflict.resolve', 'task.retry')").select(F.col("request_id").alias("old"), F.lit(1).alias("ok"))
    return each.join(ok, "old", "left").groupBy("request_id").agg(F.count("*").alias("expected"), F.count("ok").alias("observed")).withColumn("accepted", F.col("expected") == F.col("observed"))


def enqueue(accepted: DataFrame) -> DataFrame:
    """The event and task of every accepted request."""
    return accepted.select("request_id", derived_id("evt", F.col("request_id")).alias("event_id"), derived_id("tsk", F.col("request_id")).alias("task_id"), F.lit("pending").alias("state"), F.lit("d1_committed").alias("accepted"))


def accept_batch(batch: DataFrame, nodes: DataFrame, gates: DataFrame, requests: DataFrame, epoch: str, protocol: str, version: int) -> DataFrame:
    """Every arrival of a batch as it fares in order of ``event_seq``: (event_seq, request_id, answer, code, node_id).

    ``batch`` has envelopes with event_seq and content_hash, targets by id; ``requests`` are those
    accepted before (request_id, content_hash, workspace_epoch, operation, node_id, effect). The
    answer is ``accepted``, ``replay`` or ``rejected`` with a code.

    What an arrival meets of its own batch is always earlier: the same request id, a
    dependency, a create of its parent or node that is still pending, a deletion above it, a request
    that it replaces. So the answers are settled round by round until none changes; a
    round is a few equi-joins, and there are as many as the longest chain of arrivals that hang on each other.
    """
    c = F.col
    creates = c("operation").isin("directory.create", "snapshot.create")
    rows = batch.select(
        "event_seq", "content_hash", c("requestId").alias("request_id"), "operation", c("workspaceEpoch").alias("epoch"), "dependsOn", "replaces", "baseRevision",
        F.coalesce(c("target.nodeId"), F.when(creates, derived_id("node", c("requestId")))).alias("node_id"), c("target.parentId").alias("parent_id"), c("target.name").alias("name"), c("target.kind").alias("kind"), envelope_code(protocol, version).alias("malformed"),
    )
    known = requests.select("request_id", c("content_hash").alias("known_hash"))
    held = cut(rows.select("node_id").union(rows.select("parent_id")).where("node_id IS NOT NULL").distinct())
    stops = blocked(nodes, gates)
    coded = target_codes(rows.select("event_seq", "operation", "node_id", "parent_id", "name"), nodes, stops).select("event_seq", c("code").alias("target_code"))
    missing_parent = nodes.select(c("node_id").alias("parent_id"), F.lit(True).alias("parent_known"))
    domain = c("parent_id").isNull()
    kind = F.coalesce("kind", F.when(c("operation") == "snapshot.create", "snapshot").when(domain, "domain").otherwise("directory"))
    shape = (
        F.when(creates & c("name").isNull(), "invalid_name")
        .when(creates & (((kind == "domain") & ~domain) | ((kind != "domain") & domain) | ~kind.isin("domain", "directory", "snapshot")), "invalid_target")
        .when((c("operation") == "directory.rename") & c("name").isNull(), "invalid_target")
        .when((c("operation") == "snapshot.patch") & c("baseRevision").isNull(), "invalid_base_revision")
    )
    first = F.when(c("malformed").isNotNull(), c("malformed")).when(~c("operation").isin(*PROJECTED), "unsupported_operation").when(c("epoch") != epoch, "workspace_epoch_mismatch")
    base = rows.join(known, "request_id", "left").join(coded, "event_seq")
    base = _meet(base.select("event_seq", *(n for n in base.columns if n != "event_seq")), missing_parent, "parent_id").join(nodes.select("node_id", c("lifecycle").alias("node_known")), "node_id", "left")
    base = base.withColumns({"first": first, "shape": shape}).select("event_seq", "request_id", "content_hash", "known_hash", "operation", "epoch", "dependsOn", "replaces", "node_id", "parent_id", "target_code", "parent_known", "node_known", "first", "shape")
    base = cut(base)
    above = cut(closure(nodes, held).select("node_id", "ancestor_id"))
    old = requests.select(c("request_id").alias("other"), c("workspace_epoch").alias("other_epoch"), "operation", "node_id", "effect", F.lit(-1).cast("bigint").alias("other_seq"))
    accepted = cut(base.where(c("first").isNull()).select("event_seq"))
    before = _digest(accepted)
    while True:
        own = base.join(accepted, "event_seq", "left_semi")
        there = cut(old.union(own.select(c("request_id").alias("other"), c("epoch").alias("other_epoch"), "operation", "node_id", F.lit("pending").alias("effect"), c("event_seq").alias("other_seq"))))
        settled = cut(_settle(base, own, there, above, epoch))
        accepted = settled.where("answer = 'accepted'").select("event_seq")
        after = _digest(accepted)
        if after == before:
            return settled
        before = after


def _digest(rows: DataFrame) -> tuple:
    return tuple(rows.agg(F.count("*"), F.expr("bit_xor(xxhash64(event_seq))")).first())


def _settle(base: DataFrame, own: DataFrame, there: DataFrame, above: DataFrame, epoch: str) -> DataFrame:
    """One round of ``accept_batch``: the answers, given which arrivals (``own``) and older requests are ``there``."""
    c = F.col
    seq = c("other_seq") < c("event_seq")
    creates = c("operation").isin("directory.create", "snapshot.create")
    twin = own.groupBy("request_id").agg(F.min_by("content_hash", "event_seq").alias("twin_hash"), F.min("event_seq").alias("twin_seq"))
    deps = base.select("event_seq", c("request_id").alias("self"), F.posexplode("dependsOn").alias("pos", "other"))
    deps = deps.join(there.select("other", "other_epoch", "other_seq"), "other", "left")
    bad = F.when(~F.coalesce(c("other_seq") < c("event_seq"), F.lit(False)), F.when(c("other") == c("self"), "dependency_cycle").otherwise("dependency_missing")).when(c("other_epoch") != epoch, "dependency_epoch_mismatch")
    # Of several rows of one dependency a good one counts.
    each = deps.groupBy("event_seq", "pos").agg(F.min(F.struct(bad.isNotNull().alias("is_bad"), bad.alias("code"))).alias("d"))
    deps = each.where("d.is_bad").groupBy("event_seq").agg(F.min(F.struct("pos", "d.code")).alias("d")).select("event_seq", c("d.code").alias("dependency_code"))
    pending = there.where("effect = 'pending'").select("other", "operation", "node_id", "other_seq")
    removed = pending.where("operation = 'directory.delete'").groupBy("node_id").agg(F.min("other_seq").alias("gate_seq"))
    # A deletion blocks its node and all below it; one of a node that was never there blocks that name.
    gates = above.join(removed.withColumnRenamed("node_id", "ancestor_id"), "ancestor_id").select("node_id", "gate_seq").union(removed)
    at = lambda test, name: F.when(test, c("other_seq")).alias(name)
    none = F.lit(None).cast("bigint")
    facts = pending.select("node_id", at(creates, "parent_seq"), c("other_seq").alias("taken_seq"), at(c("operation") == "directory.delete", "delete_seq"), none.alias("gate_seq"))
    facts = facts.union(gates.select("node_id", none, none, none, "gate_seq")).groupBy("node_id").agg(*(F.min(n).alias(n) for n in ("parent_seq", "taken_seq", "delete_seq", "gate_seq")))
    old = base.select("event_seq", F.explode("replaces").alias("other")).join(there.select("other", "other_epoch", c("operation").alias("other_operation"), "effect", "other_seq"), "other", "left")
    gone = ~F.coalesce(seq & (c("other_epoch") == epoch), F.lit(False))
    fixed = (c("effect") != "pending") | c("other_operation").isin("directory.delete", "conflict.resolve", "task.retry")
    old = old.groupBy("event_seq").agg(F.min(F.when(gone, "replace_target_not_found").when(fixed, "replace_target_not_allowed")).alias("replace_code"))
    wide = base.join(twin, "request_id", "left").join(deps, "event_seq", "left").join(old, "event_seq", "left").join(facts.drop("parent_seq"), "node_id", "left")
    over = facts.select(c("node_id").alias("parent_id"), "parent_seq", c("gate_seq").alias("parent_gate_seq"))
    wide = _meet(wide.select("event_seq", *(n for n in wide.columns if n != "event_seq")), over, "parent_id")
    before = lambda name: F.coalesce(c(name) < c("event_seq"), F.lit(False))
    provisional = creates & c("parent_known").isNull() & (c("target_code") == "target_not_found") & before("parent_seq")
    # The target's code stops at the parent; what else could be wrong is the node's own id.
    target = F.when(~provisional, c("target_code")).when(c("node_known") == "deleted", "target_deleted").when(c("node_known").isNotNull(), "target_exists")
    code = (
        c("first"),
        F.when(c("known_hash").isNotNull(), F.when(c("known_hash") == c("content_hash"), "replay").otherwise("request_id_conflict")),
        F.when(before("twin_seq"), F.when(c("twin_hash") == c("content_hash"), "replay").otherwise("request_id_conflict")),
        c("dependency_code"),
        c("shape"),
        F.when(creates & before("parent_gate_seq"), "target_deleted"),
        F.when(~creates & before("gate_seq"), "target_deleted"),
        target,
        F.when((c("operation") == "directory.move") & before("parent_gate_seq"), "target_not_found"),
        F.when(creates & c("node_known").isNull() & before("delete_seq"), "target_deleted"),
        F.when(creates & before("taken_seq"), "target_exists"),
        c("replace_code"),
    )
    told = F.coalesce(*code)
    answer = F.when(told.isNull(), "accepted").when(told == "replay", "replay").otherwise("rejected")
    return wide.select("event_seq", "request_id", answer.alias("answer"), F.when(told != "replay", told).alias("code"), "node_id")
