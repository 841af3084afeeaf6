"""Tool calls, neighbours, line dedup and archives on small tables."""

import gzip
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ann, chat, linededup, warc

CALLS = "conv_id bigint, turn bigint, call_id string, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id bigint, turn bigint, call_id string, content string"


def link(spark, calls, results, schemas=()):
    got = chat.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), spark.createDataFrame(list(schemas), "name string, schema string"))
    return {(r["conv_id"], r["call_id"], r["status"]): r for r in got.collect()}


def test_links_orders_and_statuses(spark):
    calls = [
        (1, 0, "a", "f", '{"b":1,"a":[1.5,null]}', []),
        (1, 2, "b", "f", "{}", ["a", "not-here"]),
        (2, 0, "x", "f", "{}", ["y"]),  # waits for a later call
        (2, 1, "y", "f", "{}", []),
        (3, 0, "p", "f", "{}", ["q"]),  # a loop
        (3, 1, "q", "f", "{}", ["p"]),
        (3, 2, "r", "f", "{}", []),
        (1, 4, "a", "f", "{}", []),  # the same identifier again
        (None, 0, "n", "f", "{}", []),
        (4, None, "t", None, None, None),
    ]
    results = [(1, 1, "a", "done é"), (1, 3, "a", "done twice"), (1, 5, "zz", "nobody asked"), (None, 1, "n", "null")]
    got = link(spark, calls, results)
    assert got[1, "a", "linked"]["json"] == '{"arguments":{"a":[1.5,null],"b":1},"call_id":"a","name":"f","result":"done é"}'
    assert got[1, "a", "linked"]["position"] == 1 and got[1, "b", "unanswered"]["position"] == 2
    assert got[2, "y", "unanswered"]["position"] == 1 and got[2, "x", "unanswered"]["position"] == 2
    assert got[3, "p", "cycle"]["position"] is None and got[3, "r", "unanswered"]["position"] == 1
    assert {k[2] for k in got if k[1] == "zz" or k[0] is None} == {"orphan_result", "unanswered"}
    assert (1, "a", "duplicate_call") in got and (1, "a", "duplicate_result") in got
    assert got[4, "t", "unanswered"]["error"] == "not an object"
    assert len(got) == len(calls) + 3
    assert link(spark, [], []) == {}


def test_many_turns_keep_their_order(spark):
    n = 300
    got = link(spark, [(7, i, f"c{i:03}", "f", "{}", [f"c{i - 1:03}"] if i else []) for i in range(n)], [])
    assert [got[7, f"c{i:03}", "unanswered"]["position"] for i in range(n)] == list(range(1, n + 1))


@pytest.mark.parametrize(
    "value,schema,error",
    [
        ({"a": 1}, {"type": "object", "required": ["b"]}, "b is missing"),
        ({"a": "x"}, {"properties": {"a": {"type": "integer"}}}, "a: not an integer"),
        ({"a": True}, {"properties": {"a": {"type": "number"}}}, "a: not a number"),
        ({"a": {"b": [1, "x"]}}, {"properties": {"a": {"properties": {"b": {"items": {"type": "integer"}}}}}}, "a.b[1]: not an integer"),
        ({"z": 1}, {"additionalProperties": False}, "z: not allowed"),
        ("abc", {"maxLength": 2}, "too long"),
        (5, {"minimum": 6}, "too small"),
        ("q", {"enum": ["p"]}, "not one of the allowed values"),
        ([1], {"minItems": 2}, "wrong number of items"),
        (None, {"type": ["null", "string"]}, None),
        (2.0, {"type": "integer"}, None),
    ],
)
def test_schemas(value, schema, error):
    assert chat.violation(value, schema) == error


def test_schema_of_a_tool(spark):
    schema = json.dumps({"type": "object", "required": ["q"]})
    got = link(spark, [(1, 0, "a", "f", "{}", []), (1, 1, "b", "f", "{oops", []), (1, 2, "c", "g", "{}", [])], [], [("f", schema)])
    assert [got[1, c, "unanswered"]["error"] for c in "abc"] == ["q is missing", "arguments are not JSON", None]


def embeddings(spark, vectors):
    return spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>, label int")


def brute(vectors, q, k=10):
    d = sorted((float(np.sqrt(((np.float32(v).astype(float) - np.float32(vectors[q]).astype(float)) ** 2).sum())), i) for i, v in enumerate(vectors) if i != q)
    return [(i, s) for s, i in d[:k]]


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    vectors = [(centres[rng.integers(12)] + 0.3 * rng.normal(size=16)).tolist() for _ in range(2500)]
    got = ann.search(embeddings(spark, vectors)).collect()
    hit = 0
    for q in range(0, 2500, 100):
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert [r["score"] for r in own] == sorted(r["score"] for r in own)
        want = brute(vectors, q)
        hit += len({r["vec_id"] for r in own} & {i for i, _ in want})
    assert hit >= 0.9 * 250


def test_neighbours_of_copies_and_odd_vectors(spark):
    vectors = [[1.0, 2.0]] * 30 + [[0.0, 0.0], None, [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [], [1.0, 2.0, 3.0]] + [[5.0, 5.0]]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(embeddings(spark, vectors)).collect()]
    assert sorted(got) == [(0, i, i, 0.0) for i in range(1, 11)]
    few = ann.search(embeddings(spark, [[1.0], [3.0], [2.0]])).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in few) == [(1, 2, 1.0), (2, 1, 2.0)]
    assert ann.search(embeddings(spark, [[0.0], None])).count() == 0
    assert ann.search(embeddings(spark, [[0.0]]).limit(0)).count() == 0


def test_graph_reaches_the_nearest():
    rng = np.random.default_rng(4)
    graph = ann.CentroidGraph(rng.normal(size=(400, 8)))
    queries = rng.normal(size=(100, 8))
    ids, _ = graph.search(queries)
    exact = np.argmin(ann.squared(queries, graph.centroids), axis=1)
    assert (ids[:, 0] == exact).mean() >= 0.97


def lines(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, bad string")


def test_line_dedup(spark):
    wide, near, narrow = "seen everywhere", "on nine sites", "on one site"
    rows = []
    for i in range(40):
        own = f"text of its own number {i} with enough words to stand"
        rows.append((i, "\n".join([own, f"  {wide}\t", narrow if i % 20 == 0 else own[::-1], near if i % 20 < 9 else "", own]), f"s{i % 20}", "extra"))
    rows += [(100, None, "s1", "x"), (101, "", "s2", "x"), (102, wide, "s3", "x"), (103, f"{wide}\n\n{wide}\nshort", None, "x"), (104, rows[0][1], "s0", "x"), (104, rows[0][1], "s0", "x")]
    got = [r.asDict() for r in linededup.remove_boilerplate(lines(spark, rows)).collect()]
    assert len(got) == len(rows) and all(r["bad"] in ("extra", "x") for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["text"] == rows[1][1].replace(f"\n  {wide}\t", "") and by[1]["n_removed"] == 1 and by[1]["n_lines"] == 5
    assert near in by[1]["text"] and narrow in by[0]["text"]
    assert by[100]["text"] is None and by[100]["n_lines"] == 0 and by[101]["text"] == ""
    assert by[102]["text"] == wide and by[103]["text"] == rows[43][1]  # mostly boilerplate: a copy, left to near-dedup
    assert linededup.remove_boilerplate(lines(spark, [])).count() == 0
    spread = linededup.spread_lines(lines(spark, rows), 9).count()
    assert spread == 2 and linededup.spread_lines(lines(spark, rows), 21).count() == 0


def test_warc(spark, tmp_path):
    same, small = "p" * 1000, "q" * 999
    html = [same, "é" * 600, same, small, small, None, "", same, "x\r\n\r\ny", "z" * 200_000]
    pages = spark.createDataFrame([(i, f"http://h/{i} ü", h, 1) for i, h in enumerate(html)] + [(20, None, "no url", 1)], "page_id bigint, url string, html string, keeper int")
    got = {r["page_id"]: r for r in warc.archive_pages(spark, pages, f"file://{tmp_path}/w").collect()}
    assert len(got) == 11
    for i, h in enumerate(html):
        raw = (h or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", 7) if i in (0, 2) else ("response", None))
    index = spark.read.parquet(f"{tmp_path}/w/index").orderBy("file", "offset").collect()
    for r in index:
        with open(f"{tmp_path}/w/archives/{r['file']}", "rb") as f:
            f.seek(r["offset"])
            assert gzip.decompress(f.read(r["length"])).startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode())
    some = spark.read.parquet(f"{tmp_path}/w/index").where(F.col("page_id").isin(3, 9))
    assert {r["page_id"] for r in warc.read_selected(some, f"file://{tmp_path}/w", gap=0, most=1).collect()} == {3, 9}
    assert warc.archive_pages(spark, pages.limit(0), f"file://{tmp_path}/none").count() == 0
