"""Dependencies, idempotency, tasks, leases, the outbox and its guards."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import BACKOFF_SECONDS, CLIENT_LEASE_SECONDS, LEASE_SECONDS, MAX_FAILURES, PERMANENT_CODES, add_seconds, backoff
from ledgerloom.session import cut

DEPENDENCY_LIMIT = 32


def dependency_states(dependencies: DataFrame, effects: DataFrame, cycles: DataFrame | None = None, epoch: str | None = None) -> DataFrame:
    """(request_id, dependency): the first dependency, by position, that is not ready decides; a cycle comes before all.

    With an ``epoch``, dependencies and effects have a workspace_epoch: a request of another epoch
    is told before all else, a dependency of another one than its request's when its turn comes.
    """
    known = effects.select(F.col("request_id").alias("depends_on"), "effect", "target_deleted", "superseded_by", F.lit(True).alias("found"), (F.col("workspace_epoch") if epoch else F.lit(None).cast("string")).alias("its_epoch"))
    gone = (F.col("effect") == "cancelled") | F.col("target_deleted")
    own = F.col("workspace_epoch") if epoch else F.lit(None).cast("string")
    code = (
        F.when(F.col("found").isNull(), "dependency_missing")
        .when(F.col("its_epoch") != own, "dependency_epoch_mismatch")
        .when(F.col("effect") == "conflict", "dependency_replan_required")
        .when(F.col("effect") == "needs_attention", "dependency_blocked")
        .when(gone & F.col("superseded_by").isNotNull(), "dependency_superseded")
        .when(gone, "dependency_cancelled")
        .when(~F.col("effect").isin("applied", "applied_noop"), "dependency_pending")
    )
    each = dependencies.join(known, "depends_on", "left").select("request_id", "pos", code.alias("code"), (own != F.lit(epoch)).alias("foreign"))
    first = each.groupBy("request_id").agg(F.min(F.when(F.col("code").isNotNull(), F.struct("pos", "code"))).alias("bad"), F.max("foreign").alias("foreign"))
    foreign = F.when(F.col("foreign"), "workspace_epoch_mismatch")
    if cycles is None:
        return first.select("request_id", F.coalesce(foreign, "bad.code", F.lit("ready")).alias("dependency"))
    return first.join(cycles.select("request_id", F.lit("dependency_cycle").alias("c")), "request_id", "left").select("request_id", F.coalesce(foreign, "c", "bad.code", F.lit("ready")).alias("dependency"))


def dependency_cycles(dependencies: DataFrame, limit: int = DEPENDENCY_LIMIT) -> DataFrame:
    """(request_id): requests that reach themselves, or reach more than ``limit`` requests, which counts as a cycle.

    A row a request holds what it reaches in up to so many steps (``seen``, at most one more than the limit) and what lies exactly
    that far (``far``). A round joins it with the rows of those that are ``far``, which doubles the steps, so
    there are as many rounds as the limit has binary digits. A request past the limit is settled, and so is all that reaches it.
    """
    edges = dependencies.select(F.col("request_id").alias("a"), F.col("depends_on").alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    few = edges.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy("b"))).where(F.col("k") <= limit + 1)
    state = few.groupBy("a").agg(F.collect_list("b").alias("seen"))
    # An ``over`` row keeps no lists: whoever reaches it is over as well.
    state = cut(state.select("a", (F.size("seen") > limit).alias("over"), "seen", F.col("seen").alias("far")))
    none = F.array().cast("array<string>")
    while True:
        moving = state.where(~F.col("over") & (F.size("far") > 0))
        if moving.isEmpty():
            break
        steps = moving.select(F.col("a").alias("of"), F.explode("far").alias("a"))
        met = steps.join(state.select("a", "over", F.when(~F.col("over"), F.col("seen")).alias("seen"), F.when(~F.col("over"), F.col("far")).alias("far")), "a")
        # ``far`` has at most limit + 1 entries, so a row gathers at most that many lists of that length.
        more = met.groupBy("of").agg(F.max("over").alias("m_over"), F.flatten(F.collect_list("seen")).alias("m_seen"), F.flatten(F.collect_list("far")).alias("m_far")).withColumnRenamed("of", "a")
        live = ~F.col("over") & (F.size("far") > 0)
        seen = F.when(live, F.array_union("seen", F.coalesce("m_seen", none))).otherwise(F.col("seen"))
        far = F.when(live, F.array_except(F.coalesce("m_far", none), "seen")).otherwise(none)
        over = F.col("over") | F.coalesce("m_over", F.lit(False)) | (F.size("new") > limit)
        state = cut(state.join(more, "a", "left").withColumn("new", seen).select("a", over.alias("over"), F.slice("new", 1, limit + 1).alias("seen"), far.alias("far")))
    return state.where(F.col("over") | F.array_contains("seen", F.col("a"))).select(F.col("a").alias("request_id"))


def predecessors(tasks: DataFrame) -> DataFrame:
    """(task_id, blocked): an earlier task of the same node is neither completed nor cancelled."""
    unfinished = tasks.where(~F.col("state").isin("completed", "cancelled")).groupBy("node_id").agg(F.min("event_seq").alias("first_open"))
    return tasks.join(unfinished, "node_id", "left").select("task_id", F.coalesce(F.col("first_open") < F.col("event_seq"), F.lit(False)).alias("blocked"))


def deduplicated(requests: DataFrame) -> DataFrame:
    """The first arrival (event_seq) of every request id, with how often it came and whether with another content."""
    return requests.groupBy("request_id").agg(F.min_by(F.struct("event_seq", "content_hash"), "event_seq").alias("first"), F.count("*").alias("arrivals"), (F.min("content_hash") != F.max("content_hash")).alias("conflict")).select("request_id", "first.event_seq", "first.content_hash", "arrivals", "conflict")


def answers(requests: DataFrame) -> DataFrame:
    """Each arrival as ``new``, ``replay`` of the same content, or ``request_id_conflict``."""
    first = requests.groupBy("request_id").agg(F.min_by("content_hash", "event_seq").alias("first_hash"), F.min("event_seq").alias("first_seq"))
    answer = F.when(F.col("event_seq") == F.col("first_seq"), "new").when(F.col("content_hash") == F.col("first_hash"), "replay").otherwise("request_id_conflict")
    return requests.join(first, "request_id").select("request_id", "event_seq", answer.alias("answer"))


def due(tasks: DataFrame, now: Column) -> DataFrame:
    """Pending or queued tasks whose time has come, and those whose lease has run out."""
    state = F.col("state")
    return tasks.where((state.isin("pending", "queued") & (F.col("available_at") <= now)) | ((state == "processing") & (F.col("lease_until") <= now)))


def claimable(tasks: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """The due tasks, all and in no order, whose dependencies are ready and whose node has no earlier open task."""
    ready = due(tasks, now).join(predecessors(tasks).where("NOT blocked"), "task_id").join(states, "request_id", "left").where(F.coalesce("dependency", F.lit("ready")) == "ready")
    return ready.select("task_id", "event_seq", "node_id", "state")


def next_task(tasks: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """The claimable task of least sequence, if there is one."""
    return claimable(tasks, states, now).orderBy("event_seq").limit(1)


def claim(tasks: DataFrame, now: Column, owner: str) -> DataFrame:
    """The tasks after a claim of all that are given: processing, epoch and lease renewed."""
    return tasks.withColumns({"state": F.lit("processing"), "lease_owner": F.lit(owner), "lease_epoch": F.col("lease_epoch") + 1, "lease_until": add_seconds(now, LEASE_SECONDS)})


def after_failure(tasks: DataFrame, now: Column) -> DataFrame:
    """The tasks after one more failure: pending again after a wait, or in need of attention."""
    n = F.col("failure_count") + 1
    parked = n >= MAX_FAILURES
    return tasks.select("task_id", n.cast("int").alias("failure_count"), F.when(parked, "needs_attention").otherwise("pending").alias("state"), backoff(n).cast("int").alias("wait_seconds"), F.when(~parked, add_seconds(now, backoff(n))).alias("available_at"))


def deferred(tasks: DataFrame, now: Column) -> DataFrame:
    """A guard that aborts costs no failure: pending again in the first waiting time."""
    return tasks.withColumns({"state": F.lit("pending"), "available_at": add_seconds(now, BACKOFF_SECONDS[0])})


def released(tasks: DataFrame, handoffs: DataFrame, now: Column) -> DataFrame:
    """Queued tasks whose handoff (task_id, lease_epoch) failed, pending again; another epoch is left alone."""
    return tasks.where("state = 'queued'").join(handoffs, ["task_id", "lease_epoch"], "left_semi").withColumns({"state": F.lit("pending"), "available_at": now})


def retried(tasks: DataFrame, effects: DataFrame, ids: DataFrame, now: Column, reason: str = "admin_retry") -> DataFrame:
    """Tasks put back by hand, as they are then: both task and request must need attention. Their requests' effect is pending again.

    The lease's epoch goes up, so that who held the task before can write no more.
    """
    parked = effects.where("effect = 'needs_attention'").select("request_id")
    again = tasks.where("state = 'needs_attention'").join(ids, "task_id", "left_semi").join(parked, "request_id", "left_semi")
    return again.withColumns({"state": F.lit("pending"), "failure_count": F.lit(0), "lease_owner": F.lit(None).cast("string"), "lease_until": F.lit(None).cast("timestamp_ntz"), "lease_epoch": F.col("lease_epoch") + 1, "available_at": now, "last_error": F.lit(reason[:500]), "effect": F.lit("pending")})


def refused_retries(tasks: DataFrame, effects: DataFrame, ids: DataFrame) -> DataFrame:
    """The wanted retries (task_id) that may not be: no such task, or task or request needs no attention."""
    good = tasks.where("state = 'needs_attention'").join(effects.where("effect = 'needs_attention'").select("request_id"), "request_id", "left_semi").select("task_id")
    return ids.join(good, "task_id", "left_anti").select("task_id", F.lit("task_not_retryable").alias("code"))


def next_outbox(state: tuple, at: datetime, step: str, code: str) -> tuple:
    """(state, attempts, available_at, lease_until, rejected) of an outbox entry after one step; a step that does not fit is rejected."""
    name, n, available, lease, rejected = state
    # The transitions' names.
    if step == "enqueue" and name == "none":
        return "delivery_blocked" if code == "target_binding_unresolved" else "local_pending", n, at, None, rejected
    if step == "claim" and name == "local_pending" and available <= at:
        return "sending", n + 1, available, at + timedelta(seconds=CLIENT_LEASE_SECONDS), rejected
    if step == "acknowledge" and name == "sending" and lease >= at:
        return "cloud_acknowledged", n, available, None, rejected
    if step == "wait" and name == "sending":
        return "waiting_dependency", max(n - 1, 0), available, None, rejected
    if step == "release" and name == "waiting_dependency":
        return "local_pending", n, at, None, rejected
    if step == "fail" and name == "sending":
        if code in PERMANENT_CODES or n >= MAX_FAILURES:
            return "delivery_blocked", n, available, None, rejected
        return "local_pending", n, at + timedelta(seconds=BACKOFF_SECONDS[min(max(n, 1), len(BACKOFF_SECONDS)) - 1]), None, rejected
    if step == "recover" and name == "sending" and lease < at:
        return "local_pending", n, at, None, rejected
    if step == "cancel" and name != "none":
        return "cancelled", n, available, None, rejected
    return name, n, available, lease, rejected + 1


def _outbox_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Steps in order of request and sequence to one row a request; state passes from frame to frame."""
    columns = ["request_id", "state", "attempts", "available_at", "rejected"]
    row = lambda: (request, *state[:3], state[4])
    request, state = None, None
    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            if r.request_id != request or state is None:
                if state is not None:
                    out.append(row())
                request, state = r.request_id, ("none", 0, None, None, 0)
            state = next_outbox(state, r.at.to_pydatetime(), r.step, r.code)
        yield pd.DataFrame(out, columns=columns)
    if state is not None:
        yield pd.DataFrame([row()], columns=columns)


def fold_outbox(steps: DataFrame) -> DataFrame:
    """The outbox after its steps (request_id, seq, at, step, code): state, attempts and when it is due.

    Steps that do not fit the state change nothing and are counted as ``rejected``. Requests are folded as a
    stream of sorted rows: how many steps one has does not matter.
    """
    rows = steps.where("request_id IS NOT NULL").select("request_id", "seq", F.col("at").cast("timestamp_ntz").alias("at"), "step", "code")
    return rows.repartition("request_id").sortWithinPartitions("request_id", "seq").mapInPandas(_outbox_rows, "request_id string, state string, attempts int, available_at timestamp_ntz, rejected int")


def due_outbox(outbox: DataFrame, now: Column, limit: int) -> DataFrame:
    """The first entries to be sent: pending ones whose time has come, the longest waiting first."""
    return outbox.where((F.col("state") == "local_pending") & (F.col("available_at") <= now)).orderBy("available_at", "request_id").limit(limit)


def expired(outbox: DataFrame, now: Column) -> DataFrame:
    return outbox.where((F.col("state").isin("processing", "sending")) & (F.col("lease_until").isNull() | (F.col("lease_until") < now)))


# Guards: each returns the rows that would abort the batch; none, and it may go through.


def stale_leases(guards: DataFrame, tasks: DataFrame, now: Column) -> DataFrame:
    """Guards (task_id, owner, expected_epoch) whose task is not held by this owner in this epoch until after now."""
    held = tasks.where((F.col("state") == "processing") & (F.col("lease_until") > now)).select("task_id", F.col("lease_owner").alias("owner"), F.col("lease_epoch").alias("expected_epoch"))
    return guards.join(held, ["task_id", "owner", "expected_epoch"], "left_anti").select("task_id", F.lit("stale_task_write").alias("code"))


def stale_catalog(guards: DataFrame, meta: DataFrame) -> DataFrame:
    return guards.where("expected_catalog_revision IS NOT NULL").join(F.broadcast(meta.select("catalog_revision").limit(1)), F.col("expected_catalog_revision") != F.col("catalog_revision")).select("task_id", F.lit("stale_catalog_revision").alias("code"))


def stale_nodes(guards: DataFrame, nodes: DataFrame) -> DataFrame:
    """A deletion needs its node ``deleting``, anything else ``active``."""
    wanted = guards.where("expected_node_id IS NOT NULL").withColumn("lifecycle", F.when(F.col("operation") == "directory.delete", "deleting").otherwise("active"))
    return wanted.join(nodes.select(F.col("node_id").alias("expected_node_id"), "lifecycle"), ["expected_node_id", "lifecycle"], "left_anti").select("task_id", F.lit("stale_node_state").alias("code"))


def gated_writes(guards: DataFrame, gates: DataFrame) -> DataFrame:
    return guards.where("operation <> 'directory.delete'").join(gates.select(F.col("node_id").alias("expected_node_id")), "expected_node_id", "left_semi").select("task_id", F.lit("deletion_gate_blocks_write").alias("code"))


def stale_snapshots(guards: DataFrame, snapshots: DataFrame) -> DataFrame:
    return guards.where("expected_snapshot_revision IS NOT NULL").join(snapshots.select(F.col("node_id").alias("expected_node_id"), F.col("revision").alias("expected_snapshot_revision")), ["expected_node_id", "expected_snapshot_revision"], "left_anti").select("task_id", F.lit("stale_snapshot_revision").alias("code"))


def revision_regressions(writes: DataFrame) -> DataFrame:
    """Writes (node_id, seq, revision) below the revision before them."""
    before = F.lag("revision").over(Window.partitionBy("node_id").orderBy("seq"))
    return writes.withColumn("before", before).where(F.col("revision") < F.col("before")).select("node_id", "seq", F.lit("snapshot_revision_regression").alias("code"))


def wrong_counts(claims: DataFrame, rows: DataFrame, key: str, name: str = "observed") -> DataFrame:
    """Claims (key, expected) whose number of rows is another."""
    counted = rows.groupBy(key).agg(F.count("*").alias(name))
    return claims.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0))).where(F.col(name) != F.col("expected"))
