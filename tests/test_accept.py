"""Acceptance of a batch against one that takes the arrivals one by one."""

import random

import pytest

from ledgerloom.plans import accept
from ledgerloom.sources.tables import ENVELOPE

EPOCH, OTHER = "0" * 32, "f" * 32
NODES = [("dom", None, "project", "domain", "active"), ("dir1", "dom", "one", "directory", "active"), ("dir2", "dom", "two", "directory", "active"), ("sub1", "dir1", "sub", "directory", "active"), ("snap", "sub1", "notes", "snapshot", "active"), ("dead", "dom", "old", "directory", "deleted"), ("lost", "dead", "in-old", "snapshot", "active"), ("gate", "dom", "gated", "directory", "active"), ("held", "gate", "x", "snapshot", "active")]
GATES = {"gate"}
OLD = [("req-old-0001", "h1", EPOCH, "snapshot.patch", "snap", "pending"), ("req-old-0002", "h2", EPOCH, "snapshot.create", "prov", "pending"), ("req-old-0003", "h3", OTHER, "snapshot.patch", "snap", "applied"), ("req-old-0004", "h4", EPOCH, "directory.delete", "gate", "pending"), ("req-old-0005", "h5", EPOCH, "snapshot.patch", "snap", "applied")]


def one_by_one(batch):
    nodes = {n[0]: dict(zip(("id", "parent", "name", "kind", "state"), n)) for n in NODES}
    gates = set(GATES)
    requests = {r[0]: dict(zip(("id", "hash", "epoch", "op", "node", "effect", "seq"), (*r, -1))) for r in OLD}

    def chain(n):
        while n is not None and n in nodes:
            yield n
            n = nodes[n]["parent"]

    def blocked(n):
        return any(nodes[a]["state"] != "active" or a in gates for a in chain(n))

    def sibling(parent, name, but=None):
        found = sorted(n["id"] for n in nodes.values() if n["parent"] == parent and n["name"] == name and n["state"] != "deleted")
        return bool(found) and not (found == [but])

    def judge(e):
        op, t = e["operation"], e["target"]
        if e["workspaceEpoch"] != EPOCH:
            return "workspace_epoch_mismatch"
        if e["requestId"] in requests:
            return "replay" if requests[e["requestId"]]["hash"] == e["content_hash"] else "request_id_conflict"
        for d in e["dependsOn"] or []:
            if d not in requests:
                return "dependency_cycle" if d == e["requestId"] else "dependency_missing"
            if requests[d]["epoch"] != EPOCH:
                return "dependency_epoch_mismatch"
        node, parent = t["nodeId"], t["parentId"]
        pending = [r for r in requests.values() if r["effect"] == "pending" and r["node"] == node]
        if op.endswith(".create"):
            kind = t["kind"] or ("snapshot" if op == "snapshot.create" else "domain" if parent is None else "directory")
            if (kind == "domain") != (parent is None):
                return "invalid_target"
            if parent is not None:
                if parent not in nodes:
                    if not any(r["effect"] == "pending" and r["node"] == parent and r["op"].endswith(".create") for r in requests.values()):
                        return "target_not_found"
                elif nodes[parent]["state"] != "active" or blocked(parent):
                    return "target_deleted"
                elif nodes[parent]["kind"] == "snapshot":
                    return "invalid_target"
            if sibling(parent, t["name"]):
                return "name_conflict"
            if node in nodes:
                return "target_deleted" if nodes[node]["state"] == "deleted" else "target_exists"
            if pending:
                return "target_exists"
        elif op == "directory.delete" and node not in nodes:
            if any(r["op"] == "directory.delete" for r in pending):
                return "target_deleted"
            nodes[node] = {"id": node, "parent": None, "name": None, "kind": None, "state": "deleted"}
        else:
            if node not in nodes:
                return "target_not_found"
            if blocked(node):
                return "target_deleted"
            own = nodes[node]
            if op.startswith("snapshot") and own["kind"] != "snapshot" or op.startswith("directory") and own["kind"] == "snapshot":
                return "invalid_target"
            if op == "directory.rename" and sibling(own["parent"], t["name"], node):
                return "name_conflict"
            if op == "directory.move":
                if own["kind"] == "domain" or parent == node:
                    return "invalid_target"
                if parent is not None:
                    if parent not in nodes or nodes[parent]["state"] != "active":
                        return "target_not_found"
                    if nodes[parent]["kind"] == "snapshot":
                        return "invalid_target"
                    if parent in gates:
                        return "target_deleted"
                    if node in chain(parent):
                        return "invalid_target"
                if sibling(parent, own["name"], node):
                    return "name_conflict"
        worst = []
        for r in e["replaces"] or []:
            old = requests.get(r)
            if old is None or old["epoch"] != EPOCH:
                worst.append("replace_target_not_found")
            elif old["effect"] != "pending" or old["op"] in ("directory.delete", "conflict.resolve"):
                worst.append("replace_target_not_allowed")
        if worst:
            if op == "directory.delete" and nodes.get(node, {}).get("name") is None:
                nodes.pop(node, None)
            return min(worst)
        if op == "directory.delete" and nodes[node]["state"] == "active":
            nodes[node]["state"] = "deleting"
            gates.add(node)
        requests[e["requestId"]] = {"id": e["requestId"], "hash": e["content_hash"], "epoch": EPOCH, "op": op, "node": node, "effect": "pending"}
        return None

    return {e["event_seq"]: judge(e) for e in batch}


def arrival(rng, seq):
    op = rng.choice(["directory.create", "snapshot.create", "snapshot.create", "snapshot.create", "snapshot.patch", "directory.rename", "directory.move", "snapshot.delete"] if rng.random() < 0.9 else ["directory.delete"])
    ids = [n[0] for n in NODES] + ["new1", "new2", "prov", "none"]
    rid = lambda: rng.choice([r[0] for r in OLD] + [f"req-new-{rng.randrange(12):04}", f"req-one-{seq:04}"])
    new = op.endswith(".create")
    target = {"nodeId": rng.choice(["new1", "new2", "new3", "prov", "dead", "none"] if new and rng.random() < 0.8 else ids), "parentId": rng.choice([*ids, None]) if new or op == "directory.move" else None, "name": rng.choice(["one", "two", "fresh", "sub", "x", f"n{seq}"]) if new or op == "directory.rename" else None, "kind": None, "path": None}
    return {
        "protocol": "p", "apiVersion": 1, "workspaceEpoch": EPOCH if rng.random() < 0.95 else OTHER, "requestId": f"req-one-{seq:04}" if rng.random() < 0.7 else rid(), "operation": op, "target": target,
        "dependsOn": [rid()] if rng.random() < 0.25 else None, "baseRevision": 1, "changes": None, "confirmation": None, "replaces": None if rng.random() < 0.85 else [r for r in {rid(), rid()}],
        "event_seq": seq, "content_hash": rng.choice(["h1", "h2"]),
    }


@pytest.mark.parametrize("seed", range(2))
def test_batches(spark, seed):
    rng = random.Random(seed)
    batch = []
    for seq in range(90):
        e = arrival(rng, seq)
        if e["requestId"] in (e["replaces"] or []):
            e["replaces"] = None  # the envelope's own check
        batch.append(e)
    df = spark.createDataFrame([tuple(tuple(e["target"][k] for k in ("nodeId", "parentId", "name", "kind", "path")) if n == "target" else e[n] for n in [*ENVELOPE.names, "event_seq", "content_hash"]) for e in batch], type(ENVELOPE)([*ENVELOPE.fields, *spark.createDataFrame([], "event_seq bigint, content_hash string").schema.fields]))
    nodes = spark.createDataFrame(NODES, "node_id string, parent_id string, name string, kind string, lifecycle string")
    gates = spark.createDataFrame([(g,) for g in GATES], "node_id string")
    old = spark.createDataFrame(OLD, "request_id string, content_hash string, workspace_epoch string, operation string, node_id string, effect string")
    got = {r["event_seq"]: (r["answer"], r["code"]) for r in accept.accept_batch(df, nodes, gates, old, EPOCH, "p", 1).collect()}
    want = {k: ("accepted", None) if c is None else ("replay", None) if c == "replay" else ("rejected", c) for k, c in one_by_one(batch).items()}
    wrong = {k: (got[k], want[k], batch[k]["operation"], batch[k]["target"], batch[k]["dependsOn"], batch[k]["replaces"]) for k in want if got[k] != want[k]}
    assert not wrong, wrong
    assert sum(c[0] == "accepted" for c in want.values()) >= 5


def test_rows_without_a_key_are_spread_and_meet_nothing(spark):
    from pyspark.sql import functions as F

    from ledgerloom.plans.accept import _meet

    rows = spark.createDataFrame([(i, None if i % 4 else f"n{i}") for i in range(400)], "event_seq bigint, node_id string")
    facts = spark.createDataFrame([(f"n{i}", i) for i in range(0, 400, 8)] + [(None, -1)], "node_id string, x int")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = _meet(rows, facts, "node_id").withColumn("p", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r["event_seq"], r["x"]) for r in got} == {(i, i if i % 8 == 0 else None) for i in range(400)} and len(got) == 400
    assert len({r["p"] for r in got if r["node_id"] is None}) == 4
