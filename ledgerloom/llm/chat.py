"""Tool-call linking for chat records.

Calls and results meet by (conversation, call identifier) in a hash join. Calls
of a conversation get a topological order over their dependencies: where all
point backwards the order of turns is one; conversations with a forward
dependency are peeled in rounds, each placing the calls whose dependencies are
placed. Arguments are checked against the tool's schema, and each call with its
result is written as canonical JSON (sorted keys, no spaces, UTF-8).

Statuses: ``linked``; ``unanswered``, a call without a result; ``duplicate_call``
and ``duplicate_result``, of rows with one identifier all but the first by turn and
content; ``orphan_result``, a result without a call; ``cycle``, a call that waits for
itself. Only linked and unanswered calls have a position.

Rows: null conversations or identifiers never link; null arguments fail
validation; a dependency that is not in the conversation is ignored;
a tool without a schema accepts all arguments that are a JSON object. Other columns
of the inputs are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize

STRETCH = 64  # turns ranked together

ORACLE = """
WITH calls AS (
  SELECT conv_id, turn, text, 'call-' || conv_id || '-' || turn AS call_id FROM conversations WHERE role = 'user'
), results AS (
  SELECT conv_id, turn AS result_turn, text AS result, 'call-' || conv_id || '-' || (turn - 1) AS call_id FROM conversations WHERE role = 'assistant'
), joined AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn, r.result_turn, c.text, r.result,
         CASE WHEN c.call_id IS NULL THEN 'orphan_result' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status
  FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
)
SELECT conv_id, call_id, turn, result_turn, status,
       CASE WHEN status <> 'orphan_result' THEN row_number() OVER (PARTITION BY conv_id, status = 'orphan_result' ORDER BY turn) END AS position,
       CASE WHEN status = 'orphan_result' THEN NULL WHEN text IS NULL THEN 'prompt: not a string' WHEN length(text) < 1 THEN 'prompt: too short' WHEN length(text) > 8192 THEN 'prompt: too long' END AS error,
       CASE WHEN status <> 'orphan_result' THEN '{"arguments":{"prompt":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"turn":' || turn || '},"call_id":"' || call_id || '","name":"reply","result":' || coalesce(CAST(to_json(result) AS VARCHAR), 'null') || '}' END AS json
FROM joined
"""

REPLY_SCHEMA = {
    "type": "object",
    "required": ["prompt", "turn"],
    "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 8192}, "turn": {"type": "integer", "minimum": 0}},
    "additionalProperties": False,
}
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _is(value: object, kind: str) -> bool:
    if kind in ("integer", "number"):
        whole = isinstance(value, int) or (kind == "integer" and isinstance(value, float) and value.is_integer())
        return not isinstance(value, bool) and (whole or (kind == "number" and isinstance(value, float)))
    return isinstance(value, _TYPES[kind])


def violation(value: object, schema: dict, path: str = "") -> str | None:
    """The first way in which a value breaks a schema, or None. Knows type, enum, required, properties, additionalProperties, items and the bounds of lengths, sizes and numbers."""
    at = f"{path}: " if path else ""
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{at}not {'an' if str(kinds)[0] in 'aio' else 'a'} {kinds if isinstance(kinds, str) else ' or '.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}not one of the allowed values"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            return f"{at}too short"
        if len(value) > schema.get("maxLength", len(value)):
            return f"{at}too long"
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            return f"{at}too small"
        if value > schema.get("maximum", value):
            return f"{at}too large"
    elif isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            return f"{at}wrong number of items"
        for i, item in enumerate(value):
            if found := violation(item, schema.get("items", {}), f"{path}[{i}]"):
                return found
    elif isinstance(value, dict):
        for name in schema.get("required", ()):
            if name not in value:
                return f"{at}{name} is missing"
        properties = schema.get("properties", {})
        for name in sorted(value):
            inner = f"{path}.{name}" if path else name
            if name in properties:
                if found := violation(value[name], properties[name], inner):
                    return found
            elif schema.get("additionalProperties", True) is False:
                return f"{inner}: not allowed"
    return None


def _waves(calls: DataFrame) -> DataFrame:
    """The calls with ``wave``: 0 where all dependencies of the conversation point backwards, else the round that places it, null in a cycle."""
    edges = calls.select("conv_id", "call_id", "turn", F.explode("depends_on").alias("on")).distinct()
    known = edges.join(calls.select("conv_id", F.col("call_id").alias("on"), F.col("turn").alias("on_turn")), ["conv_id", "on"])
    forward = known.where(~F.coalesce(F.struct("on_turn", "on") < F.struct("turn", "call_id"), F.lit(False))).select("conv_id").distinct()
    hard = materialize(calls.join(forward, "conv_id", "left_semi").select("conv_id", "call_id"))
    if hard.isEmpty():
        return calls.withColumn("wave", F.lit(0))
    waiting = materialize(known.join(forward, "conv_id", "left_semi").select("conv_id", "call_id", "on"))
    placed, left, wave = None, hard, 0
    while True:
        ready = materialize(left.join(waiting, ["conv_id", "call_id"], "left_anti").withColumn("wave", F.lit(wave)))
        if ready.isEmpty():
            break
        placed = ready if placed is None else placed.union(ready)
        left = materialize(left.join(ready, ["conv_id", "call_id"], "left_anti"))
        waiting = materialize(waiting.join(ready.select("conv_id", F.col("call_id").alias("on")), ["conv_id", "on"], "left_anti").select("conv_id", "call_id", "on"))
        wave += 1
    peeled = hard if placed is None else hard.join(placed, ["conv_id", "call_id"], "left")
    peeled = peeled.withColumn("hard", F.lit(True)) if placed is not None else peeled.withColumn("wave", F.lit(None).cast("int")).withColumn("hard", F.lit(True))
    return calls.join(peeled, ["conv_id", "call_id"], "left").withColumn("wave", F.when(F.col("hard"), F.col("wave")).otherwise(0)).drop("hard")


def _positions(calls: DataFrame) -> DataFrame:
    """The calls with ``position`` from 1 within a conversation, by wave and turn: ranks within stretches of turns, on top of the counts before."""
    stretch = calls.withColumn("stretch", F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(1 << 60)))
    counts = stretch.where("wave IS NOT NULL").groupBy("conv_id", "wave", "stretch").agg(F.count("*").alias("n"))
    before = counts.select("conv_id", "wave", "stretch", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("wave", "stretch")) - F.col("n")).alias("before"))
    ranked = stretch.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id", "wave", "stretch").orderBy(F.col("turn").asc_nulls_last(), "call_id")))
    on = [ranked[c].eqNullSafe(before[c]) for c in ("conv_id", "wave", "stretch")]
    return ranked.join(before, on, "left").select(*(ranked[c] for c in calls.columns), (before["before"] + ranked["rank"]).alias("position"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Link calls (conv_id, turn, call_id, name, arguments, depends_on) with results (conv_id, turn, call_id, content) under schemas (name, schema).

    Returns conv_id, call_id, turn, result_turn, status, position, error, json.
    """
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()

    def numbered(rows: DataFrame, *order: str) -> DataFrame:
        """The rows with ``copy``, from 1 among those of one identifier; rows without one are not gathered."""
        first = F.row_number().over(Window.partitionBy("conv_id", "call_id").orderBy(*order))
        return rows.where(named).withColumn("copy", first).union(rows.where(~named).withColumn("copy", F.lit(1)))

    calls = numbered(calls.select("conv_id", "call_id", "turn", "name", "arguments", "depends_on"), "turn", "name", "arguments")
    results = numbered(results.select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content"), "result_turn", "content")
    own = calls.where((F.col("copy") == 1) | ~named)
    placed = _positions(_waves(own))
    first = results.where((F.col("copy") == 1) & named).drop("copy")
    linked = placed.join(first.withColumn("answered", F.lit(True)), ["conv_id", "call_id"], "left")
    status = F.when(F.col("wave").isNull(), "cycle").when(F.col("answered"), "linked").otherwise("unanswered")
    described = linked.withColumn("status", status).join(schemas.groupBy("name").agg(F.min("schema").alias("schema")), "name", "left")
    done = _serialize(described.select("conv_id", "call_id", "turn", "result_turn", "status", "position", "name", "arguments", "content", "schema"))
    empty = lambda df, status, turn, result_turn: df.select("conv_id", "call_id", turn.cast("bigint").alias("turn"), result_turn.cast("bigint").alias("result_turn"), F.lit(status).alias("status"), F.lit(None).cast("bigint").alias("position"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("json"))
    null = F.lit(None)
    more = empty(calls.where((F.col("copy") > 1) & named), "duplicate_call", F.col("turn"), null)
    more = more.union(empty(results.where((F.col("copy") > 1) & named), "duplicate_result", null, F.col("result_turn")))
    alone = results.where(~named).drop("copy").union(first.join(own.where(named).select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", "result_turn", "content"))
    return done.union(more).union(empty(alone, "orphan_result", null, F.col("result_turn")))


def _serialize(rows: DataFrame) -> DataFrame:
    """Validate the arguments and write the canonical JSON."""
    names = ["conv_id", "call_id", "turn", "result_turn", "status", "position"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, dict] = {None: {"type": "object"}}
        for batch in batches:
            errors, texts = [], []
            for call_id, name, arguments, content, schema in zip(*(batch.column(c).to_pylist() for c in ("call_id", "name", "arguments", "content", "schema"))):
                if schema not in known:
                    if len(known) > 1000:
                        known = {None: known[None]}
                    known[schema] = json.loads(schema)
                try:
                    value = json.loads(arguments) if arguments is not None else None
                    errors.append(violation(value, known[schema]))
                except ValueError:
                    value = arguments
                    errors.append("arguments are not JSON")
                texts.append(canonical({"call_id": call_id, "name": name, "arguments": value, "result": content}))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(errors, pa.string()), pa.array(texts, pa.string())], names=[*names, "error", "json"])

    return rows.select(*names[:2], F.col("turn").cast("bigint"), F.col("result_turn").cast("bigint"), "status", F.col("position").cast("bigint"), "name", "arguments", "content", "schema").mapInArrow(run, f"conv_id {dict(rows.dtypes)['conv_id']}, call_id string, turn bigint, result_turn bigint, status string, position bigint, error string, json string")


def link_conversations(conversations: DataFrame) -> DataFrame:
    """Conversations read as calls of one tool: a user's turn calls ``reply`` after the user's turn two before it, and an assistant's turn is the result of the turn before it."""
    spark = conversations.sparkSession
    call_id = lambda turn: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    turn = F.col("turn")
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), turn.alias("turn")), {"ignoreNullFields": "false"})
    calls = conversations.where(F.col("role") == "user").select("conv_id", "turn", call_id(turn).alias("call_id"), F.when(F.col("role") == "user", "reply").alias("name"), arguments.alias("arguments"), F.when(turn >= 2, F.array(call_id(turn - 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    results = conversations.where(F.col("role") == "assistant").select("conv_id", "turn", call_id(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return link_calls(calls, results, spark.createDataFrame([("reply", canonical(REPLY_SCHEMA))], "name string, schema string"))
