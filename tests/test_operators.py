"""Operators on small tables made here."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as fn
from ledgerloom.operators import reads, reconcile, tree, work
from ledgerloom.plans import fold
from ledgerloom.sources import tables

NODES = [("p", None, "project", "domain", "active"), ("d", "p", "12306", "directory", "active"), ("u", "d", "unit", "directory", "active"), ("s", "u", "notes", "snapshot", "active"), ("x", "p", "old", "directory", "deleted"), ("y", "x", "in-old", "snapshot", "active")]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(NODES, "node_id string, parent_id string, name string, kind string, lifecycle string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tree(spark, nodes):
    assert rows(tree.subtree(nodes, "d")) == [("d", 0), ("s", 2), ("u", 1)]
    assert rows(tree.ancestors_of(nodes, "s")) == [("d", 2), ("p", 3), ("s", 0), ("u", 1)]
    assert ("s", "project/12306/unit/notes", 4) in rows(tree.paths(nodes))
    assert all(r[0] not in ("x", "y") for r in rows(tree.paths(nodes)))
    gates = spark.createDataFrame([("d",)], "node_id string")
    assert rows(tree.blocked(nodes, gates)) == [("d", "d", 0), ("s", "d", 2), ("u", "d", 1), ("x", "x", 0), ("y", "x", 1)]
    moves = spark.createDataFrame([("d", "u"), ("d", "d"), ("u", "p")], "node_id string, new_parent_id string")
    assert {r[:2]: r[2] for r in rows(tree.move_cycles(nodes, moves).select("node_id", "new_parent_id", "cycle"))} == {("d", "u"): True, ("d", "d"): True, ("u", "p"): False}


def test_empty_tree(spark, nodes):
    none = nodes.limit(0)
    assert rows(tree.closure(none)) == [] and rows(tree.paths(none)) == [] and rows(tree.sibling_collisions(none)) == []


def test_pages(nodes):
    assert [r["name"] for r in reads.children(nodes, "p", 1).collect()] == ["12306"]
    assert reads.clamp(0) == 20 and reads.clamp(-3) == 1 and reads.clamp(99) == 50 and reads.clamp(None) == 20
    page = reads.children(nodes, "p", 1).collect()
    cursor = reads.next_cursor(page, 1, "p", 7)
    assert reads.cursor_after(cursor, "p", 7) == "12306"
    with pytest.raises(ValueError, match="cursor_stale"):
        reads.cursor_after(cursor, "p", 8)
    with pytest.raises(ValueError, match="cursor_invalid"):
        fn.decode_cursor("nonsense")
    assert reads.next_cursor(page, 2, "p", 7) is None


def test_names(spark):
    df = spark.createDataFrame([("é",), ("é",), ("JVM",), ("jvm",), ("",), (".",), ("a/b",), ("a\\b",), ("x" * 129,), ("中" * 128,), (None,)], "name string")
    got = df.select(fn.nfc("name").alias("name")).select("name", fn.name_problem(F.col("name")).alias("p")).collect()
    assert got[0]["name"] == got[1]["name"] and got[2]["name"] != got[3]["name"]
    assert [r["p"] for r in got] == [None, None, None, None, "empty", "dot_segment", "separator", "separator", "characters", None, "not_a_string"]


def test_dependencies(spark):
    effects = spark.createDataFrame([("a", "applied", False, None), ("b", "pending", False, None), ("c", "conflict", False, None), ("d", "cancelled", False, None), ("e", "applied", True, "f")], "request_id string, effect string, target_deleted boolean, superseded_by string")
    deps = spark.createDataFrame([("1", 0, "a"), ("2", 0, "b"), ("3", 0, "c"), ("4", 0, "d"), ("5", 0, "zz"), ("6", 0, "e"), ("7", 0, "a"), ("7", 1, "c"), ("7", 2, "zz")], "request_id string, pos int, depends_on string")
    got = dict(tuple(r) for r in work.dependency_states(deps, effects).collect())
    assert got == {"1": "ready", "2": "dependency_pending", "3": "dependency_replan_required", "4": "dependency_cancelled", "5": "dependency_missing", "6": "dependency_superseded", "7": "dependency_replan_required"}


def test_cycles(spark):
    loop = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "b2"), ("b2", None)]
    chain = [(f"n{i}", f"n{i + 1}") for i in range(40)]
    df = spark.createDataFrame([r for r in loop + chain if r[1]], "request_id string, depends_on string")
    got = {r[0] for r in work.dependency_cycles(df).collect()}
    assert got == {"a", "b", "c"} | {f"n{i}" for i in range(8)}


def test_outbox(spark):
    t = lambda s: datetime(2024, 1, 1, 0, s // 60, s % 60)
    steps = [
        ("a", 0, t(0), "enqueue", ""), ("a", 1, t(1), "claim", ""), ("a", 2, t(2), "acknowledge", ""),
        ("b", 0, t(0), "enqueue", ""), ("b", 1, t(1), "claim", ""), ("b", 2, t(2), "fail", "timeout"), ("b", 3, t(3), "claim", ""),
        ("c", 0, t(0), "enqueue", ""), ("c", 1, t(1), "claim", ""), ("c", 2, t(2), "fail", "request_id_conflict"),
        ("d", 0, t(0), "enqueue", ""), ("d", 1, t(1), "claim", ""), ("d", 2, t(2), "wait", ""),
        ("e", 0, t(0), "enqueue", "target_binding_unresolved"),
        ("f", 0, t(0), "enqueue", ""), ("f", 1, t(1), "claim", ""), ("f", 2, t(100), "acknowledge", ""), ("f", 3, t(101), "recover", ""),
    ]
    df = spark.createDataFrame(steps, "request_id string, seq int, at timestamp, step string, code string")
    got = {r["request_id"]: (r["state"], r["attempts"], r["rejected"]) for r in work.fold_outbox(df).collect()}
    assert got == {"a": ("cloud_acknowledged", 1, 0), "b": ("local_pending", 1, 1), "c": ("delivery_blocked", 1, 0), "d": ("waiting_dependency", 0, 0), "e": ("delivery_blocked", 0, 0), "f": ("local_pending", 1, 1)}


def test_reconciliation(spark):
    replica = spark.createDataFrame(
        [("g", None, False, False), ("k", "g", False, False), ("out", "g", True, False), ("out2", "out", False, False), ("in", "g", False, True), ("in2", "in", False, False), ("other", None, False, False)],
        "node_id string, parent_id string, moved_out boolean, moved_in boolean",
    )
    manifest = spark.createDataFrame([("g",), ("never-here",)], "node_id string")
    actions = reconcile.plan(manifest, replica)
    got = dict(tuple(r) for r in actions.collect())
    assert got == {"g": "erase", "never-here": "erase", "k": "erase", "out": "keep", "out2": "keep", "in": "conflict", "in2": "conflict", "other": "keep"}
    audit = spark.createDataFrame([], "audit_id string, node_id string")
    left, new = reconcile.apply(actions, replica, audit)
    assert {r[0] for r in left.collect()} == {"out", "out2", "in", "in2", "other"} and {r["audit_id"] for r in new.collect()} == {"erase:g", "erase:k"}
    again, none = reconcile.apply(actions, left, audit.union(new))
    assert rows(again) == rows(left) and none.count() == 0


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w"), (3, "w2")], "k int, v string")
    assert rows(tables.upsert(a, b, ["k"], ["v"])) == [(1, "x"), (2, "z"), (3, "w2")]
    assert rows(tables.insert_or_ignore(a, b, "k")) == [(3, "w")]
    tables.append(a, f"{tmp_path}/t")
    tables.append(b, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 5


def test_json_source(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"requestId":"req-00000001","operation":"snapshot.patch","protocol":"p","changes":[{"op":"set","path":["a"],"value":"1"}]}\nnot json\n')
    got = tables.requests_from_json(spark, str(tmp_path)).collect()
    assert len(got) == 2 and sum(r["raw"] is not None for r in got) == 1


def test_catalog_revisions(spark):
    ops = ["snapshot.patch", "directory.create", "directory.move", "snapshot.patch", "directory.delete"]
    df = spark.createDataFrame([(i * 3000, op) for i, op in enumerate(ops)], "event_seq bigint, operation string")
    assert [r[1] for r in rows(fold.catalog_revisions(df))] == [0, 1, 2, 2, 3]


def test_cycles_of_random_graphs_in_few_rounds(spark, monkeypatch):
    import random

    from ledgerloom.operators import work

    rng = random.Random(8)
    edges = {(f"r{rng.randrange(150)}", f"r{rng.randrange(150)}") for _ in range(110)}
    edges |= {(f"s{i}", f"s{i + 1}") for i in range(40)} | {(f"t{i}", f"t{(i + 1) % 31}") for i in range(31)}  # a long chain, a wide cycle
    edges |= {("hub", f"h{i}") for i in range(60)} | {("to_hub", "hub"), ("self", "self"), ("u0", "u1"), ("u1", "u0"), ("u0", "s20")}
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    reach = {}
    for a in after:
        todo, reach[a] = list(after[a]), set()
        while todo:
            b = todo.pop()
            if b not in reach[a]:
                reach[a].add(b)
                todo += after.get(b, ())
    rounds = []
    monkeypatch.setattr(work, "cut", lambda df: rounds.append(1) or df.localCheckpoint())
    for limit in (32, 5):
        rounds.clear()
        got = {r["request_id"] for r in work.dependency_cycles(spark.createDataFrame(sorted(edges), "request_id string, depends_on string"), limit).collect()}
        assert got == {a for a, r in reach.items() if a in r or len(r) > limit}
        assert len(rounds) <= 7
