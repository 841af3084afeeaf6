"""The merge's cases as a table, its properties, and the fold over random ledgers."""

import json

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.functions.merge import InvalidChanges, canonical, merge, overlap, put, same
from ledgerloom.plans.fold import NodeFold, fold_rows


def set_(path, value):
    return {"op": "set", "path": path, "value": value}


def remove(path):
    return {"op": "remove", "path": path}


def item(field, key, value):
    return {"op": "item_set", "path": [], "field": field, "itemId": key, "value": value}


CASES = [
    ("independent fields", {"t": "old", "n": "x"}, {"t": "old", "n": "x"}, [set_(["t"], "new"), set_(["o"], 1)], "applied", {"t": "new", "n": "x", "o": 1}),
    ("same value", {"t": "a"}, {"t": "a"}, [set_(["t"], "a")], "applied_noop", {"t": "a"}),
    ("concurrent", {"n": "x"}, {"n": "y"}, [set_(["n"], "z")], "conflict", ["concurrent_change"]),
    ("agreeing change", {"n": "x"}, {"n": "z"}, [set_(["n"], "z")], "applied_noop", {"n": "z"}),
    ("delete of a changed field", {"note": "a"}, {"note": "b"}, [remove(["note"])], "conflict", ["delete_modified"]),
    ("parent and child", {}, {}, [set_(["a"], 1), set_(["a", "b"], 2)], "conflict", ["overlapping_paths"]),
    ("all or nothing", {"a": 1, "b": 2}, {"a": 9, "b": 2}, [set_(["b"], 3), set_(["a"], 2)], "conflict", ["concurrent_change"]),
    ("another item", {"at": {"A": 1}}, {"at": {"A": 1, "B": 2}}, [item("at", "C", 3)], "applied", {"at": {"A": 1, "B": 2, "C": 3}}),
    ("item as it is", {"at": {"A": 1}}, {"at": {"A": 1}}, [item("at", "A", 1)], "applied_noop", {"at": {"A": 1}}),
    ("item changed", {"at": {"A": 1}}, {"at": {"A": 2}}, [item("at", "A", 3)], "conflict", ["item_concurrent_change"]),
    ("two new items", {}, {}, [item("at", "A", 1), item("at", "B", 2)], "applied", {"at": {"A": 1, "B": 2}}),
    ("deleted parent", {"s": {"e": 1}}, {}, [set_(["s", "new"], 1)], "conflict", ["parent_deleted"]),
    ("one item twice", {}, {}, [item("at", "X", 1), item("at", "X", 2)], "conflict", ["item_concurrent_change"]),
    ("deleted collection", {"an": {"old": 1}}, {}, [item("an", "new", 1)], "conflict", ["parent_deleted"]),
    ("remove what is gone", {"f": "old"}, {}, [remove(["f"])], "applied_noop", {}),
    ("collection that is none", {"at": 1}, {"at": 1}, [item("at", "A", 1)], "conflict", ["item_field_not_an_object"]),
    ("below a scalar", {"a": 1}, {"a": 1}, [set_(["a", "b"], 2)], "applied", {"a": {"b": 2}}),
    ("two fields at one path", {}, {}, [item("x", "A", 1), item("y", "A", 1)], "conflict", ["overlapping_paths"]),
    ("null is a value", {"a": None}, {"a": None}, [set_(["a"], 1)], "applied", {"a": 1}),
    ("item removed", {"at": {"A": 1, "B": 2}}, {"at": {"A": 1, "B": 2}}, [{"op": "item_remove", "path": [], "field": "at", "itemId": "A"}], "applied", {"at": {"B": 2}}),
    ("changed item removed", {"at": {"A": 1}}, {"at": {"A": 2}}, [{"op": "item_remove", "path": [], "field": "at", "itemId": "A"}], "conflict", ["item_delete_modified"]),
    ("one and one point zero", {"a": 1}, {"a": 1.0}, [set_(["a"], 2)], "applied", {"a": 2}),
    ("equal numbers", {"a": 1}, {"a": 5}, [set_(["a"], 5.0)], "applied_noop", {"a": 5}),
    ("a number is no truth value", {"a": 1}, {"a": True}, [set_(["a"], 2)], "conflict", ["concurrent_change"]),
    ("null collection", {"at": None}, {"at": None}, [item("at", "A", 1)], "applied", {"at": {"A": 1}}),
    ("collection new below a lost parent", {"s": {"e": 1}}, {}, [item("at", "A", 1) | {"path": ["s"]}], "applied", {"s": {"at": {"A": 1}}}),
    ("list as a value", {"l": [1]}, {"l": [1]}, [set_(["l"], [1, 2])], "applied", {"l": [1, 2]}),
]


@pytest.mark.parametrize("name,base,current,changes,status,expected", CASES, ids=[c[0] for c in CASES])
def test_case(name, base, current, changes, status, expected):
    before = canonical([base, current])
    out = merge(base, current, changes)
    assert out.status == status
    assert canonical([base, current]) == before, "the inputs stay as they are"
    if status == "conflict":
        assert [c["reason"] for c in out.conflicts] == expected
    else:
        assert out.value == expected


def test_conflicts_name_their_paths():
    lost = merge({"s": {"at": {"A": 1}}}, {"s": {}}, [item("at", "B", 2) | {"path": ["s"]}]).conflicts[0]
    assert (lost["path"], lost["parent"], lost["base"], lost["current"], lost["proposed"]) == (["s", "at"], "s/at", {"A": 1}, None, 2)
    none = merge({"s": {"at": 1}}, {"s": {"at": 1}}, [item("at", "B", 2) | {"path": ["s"]}]).conflicts[0]
    assert (none["path"], none["base"], none["current"]) == (["s"], 1, 1)
    gone = merge({"s": {"e": 1}}, {}, [set_(["s", "e"], 2)]).conflicts[0]
    assert (gone["path"], gone["parent"], gone["base"], gone["current"]) == (["s", "e"], "s", 1, None)


@pytest.mark.parametrize("changes", [[], None, "x", {}])
def test_no_changes(changes):
    with pytest.raises(InvalidChanges):
        merge({}, {}, changes)


def test_helpers():
    assert overlap((), ("a",)) and overlap(("a",), ("a", "b")) and not overlap(("a", "c"), ("a", "b"))
    assert same({"a": 1, "b": 2}, {"b": 2, "a": 1}) and not same([1, 2], [2, 1])
    assert put({"a": {"b": 1}}, ("a", "b"), 2) == {"a": {"b": 2}}


values = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab", max_size=2), lambda x: st.lists(x, max_size=2) | st.dictionaries(st.sampled_from("abc"), x, max_size=3), max_leaves=6)
documents = st.dictionaries(st.sampled_from("abc"), values, max_size=3)
paths = st.lists(st.sampled_from("abc"), min_size=1, max_size=3)
change = st.builds(set_, paths, values) | st.builds(remove, paths)


@settings(max_examples=200, deadline=None)
@given(documents, st.lists(change, min_size=1, max_size=4))
def test_unchanged_document_takes_disjoint_changes(doc, changes):
    out = merge(doc, doc, changes)
    if out.status == "conflict":
        assert {c["reason"] for c in out.conflicts} == {"overlapping_paths"}
        return
    again = merge(doc, out.value, changes)
    assert again.status == "applied_noop" or any(c["reason"] == "parent_deleted" for c in again.conflicts)


requests = st.lists(st.tuples(st.sampled_from("xyz"), st.sampled_from(["snapshot.create", "snapshot.patch", "snapshot.patch", "snapshot.delete"]), st.integers(0, 3), st.lists(change, min_size=1, max_size=2)), max_size=25)


@settings(max_examples=100, deadline=None)
@given(requests, st.integers(1, 7))
def test_batches_do_not_matter(ledger, size):
    rows = sorted((n, i, f"req-{i}", op, base, json.dumps(c)) for i, (n, op, base, c) in enumerate(ledger))
    frame = pd.DataFrame(rows, columns=["node_id", "event_seq", "request_id", "operation", "base_revision", "changes"])
    whole = pd.concat([*fold_rows(iter([frame])), pd.DataFrame()])
    parts = pd.concat([*fold_rows(iter([frame[i : i + size] for i in range(0, len(frame), size)])), pd.DataFrame()])
    assert whole.to_dict("records") == parts.to_dict("records") or whole.astype(str).values.tolist() == parts.astype(str).values.tolist()


def test_fold_of_a_node():
    node = NodeFold()
    assert node.apply("snapshot.patch", 1, [set_(["a"], 1)]) == ("cancelled", [])
    assert node.apply("snapshot.create", None, [])[0] == "applied" and node.revision == 1
    assert node.apply("snapshot.patch", 1, [set_(["a"], 1)])[0] == "applied" and node.revision == 2
    assert node.apply("snapshot.patch", 1, [set_(["a"], 1)])[0] == "applied_noop" and node.revision == 2
    assert node.apply("snapshot.patch", 1, [set_(["a"], 2)])[0] == "conflict"
    assert node.apply("conflict.resolve", None, [set_(["a"], 2)])[0] == "applied"
    assert node.apply("snapshot.patch", 99, [set_(["a"], 2)])[0] == "needs_attention"
    assert node.apply("snapshot.patch", 3, [set_(["big"], "x" * 300_000)])[0] == "needs_attention"
    assert node.apply("snapshot.delete", None, [])[0] == "applied"
    assert node.apply("snapshot.create", None, []) == ("cancelled", [])
